"""Inventories, caches and the joins between sources, questions, facts, reviews and runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.nearest import most_shared
from factloom.sources import views as V
from factloom.sources.shared import hinted, written

#: Thresholds of near duplicates and of overlap with a benchmark, and the share of label terms.
NEAR, OVERLAP, LABEL_SHARE = 0.92, 0.95, 0.6
#: One row in so many is looked at for frequent trigrams; at most so many are told apart from the others.
PART, FREQUENT = 8, 20_000
#: Trigrams of a gold text that a text must share beyond those that it may lack; the reasons of an overlap in the order of their names.
MORE = 6
REASONS = tuple((1 << i, name) for i, name in enumerate(("exact_text", "gold_passage", "near_text", "probable_fact", "same_fact")))
EXACT, PASSAGE, NEAR_TEXT, LIKELY, SAME_FACT = (bit for bit, _ in REASONS)
FILE = r"^([A-Z0-9]+)_(20\d\d)_(10K|TRANSCRIPT)\.(pdf|html|htm)$"


# -- sources ----------------------------------------------------------------------------------------


def inventory(files: DataFrame) -> DataFrame:
    """files (folder, name) with ticker, fiscal_year, doc_type and reason (null: usable)."""
    part = lambda i: F.regexp_extract("name", FILE, i)
    cut = files.select("folder", "name", part(1).alias("ticker"), part(2).alias("y"), part(3).alias("doc_type"), part(4).alias("ext"))
    # names that aren't recognised have no key in common; counts are summed where the files lie and meet them again
    key = ["ticker", "y", "doc_type"]
    cut = cut.join(cut.filter("ticker <> ''").groupBy(*key).agg(F.count("*").alias("_same")).filter("_same > 1").hint("merge"), key, "left")
    reason = (
        F.when(F.col("ticker") == "", "name not recognised")
        .when((F.col("doc_type") == "10K") & (F.col("ext") != "pdf"), "extension not allowed")
        .when(F.upper("folder") != F.col("ticker"), "folder and ticker differ")
        .when(F.col("_same").isNotNull(), "duplicate source")
    )
    return cut.select("folder", "name", F.nullif("ticker", F.lit("")).alias("ticker"), F.nullif("y", F.lit("")).cast("int").alias("fiscal_year"), F.nullif("doc_type", F.lit("")).alias("doc_type"), reason.alias("reason"))


def expected_minus(available: DataFrame) -> DataFrame:
    """Every ticker, year and type that some source has, less those available together. Years and types are short lists: over 1,000 are an error."""

    def values(c: str) -> Column:
        found = [r[0] for r in available.select(c).distinct().limit(1001).collect()]
        if len(found) > 1000:
            raise ValueError(f"more than 1,000 values of {c}")
        return F.explode(F.array(*[F.lit(v) for v in found]).cast(f"array<{dict(available.dtypes)[c]}>")).alias(c)

    wanted = available.select("ticker").distinct().select("ticker", values("fiscal_year")).select("ticker", "fiscal_year", values("doc_type"))
    return wanted.join(available.hint("merge"), ["ticker", "fiscal_year", "doc_type"], "left_anti")


def preflight(sources: DataFrame) -> DataFrame:
    """sources (id, name, content) with all reasons against each, joined; empty: none."""
    reasons = F.array_compact(F.array(
        F.when(F.octet_length("content") < 1024, "too small"), F.when(F.col("name").endswith(".pdf") & ~F.col("content").startswith("%PDF-"), "bad signature"),
        F.when(F.size(F.regexp_extract_all("content", F.lit(r"(\S+)"), 1)) < 100, "too few words"), F.when(~F.lower("content").rlike(r"\b(operator|question|the|de|der)\b"), "no cue"),
    ))
    return sources.select("id", F.array_join(reasons, ",").alias("reasons"))


def cache_key(*parts: Column) -> Column:
    """sha256 of the canonical JSON of the parts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), p.cast("string"), F.lit('"')) for p in parts]), F.lit("]")), 256)


def to_parse(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources whose key isn't in the cache, or is there with an empty result."""
    return sources.join(cache.filter("n_pages > 0").select("key"), "key", "left_anti")


def merge_inputs(*inputs: DataFrame, key: str) -> DataFrame:
    """The union of inputs with duplicates (the number of rows of a key), to be refused where over one."""
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x)
    return out.withColumn("duplicates", F.count("*").over(W.partitionBy(key)) - 1)


# -- scopes -----------------------------------------------------------------------------------------


def missing_sources(groups: DataFrame, available: DataFrame) -> DataFrame:
    """Requested groups that aren't available; one without a type is missing only where no type exists."""
    key = ["ticker", "fiscal_year"]
    typed = groups.filter("doc_type is not null").join(available.hint("merge"), [*key, "doc_type"], "left_anti").select("question_id", *key, "doc_type")
    untyped = groups.filter("doc_type is null").join(available.hint("merge"), key, "left_anti").select("question_id", *key, "doc_type")
    return typed.unionByName(untyped)


def latest_available(available: DataFrame) -> DataFrame:
    return available.groupBy("ticker", "doc_type").agg(F.max("fiscal_year").alias("fiscal_year"))


def ambiguous(available: DataFrame) -> DataFrame:
    """Companies and years that have both types."""
    return available.groupBy("ticker", "fiscal_year").agg(F.countDistinct("doc_type").alias("types")).filter("types = 2").drop("types")


def nearest_years(mentions: DataFrame, years: DataFrame, reach: int = 28) -> DataFrame:
    """question_id, ticker, year: each company's nearest year mention within reach, where a question's years are all used."""
    near = mentions.join(years.hint("merge"), "question_id").withColumn("gap", F.abs(F.col("at") - F.col("year_at"))).filter(F.col("gap") <= reach)
    best = near.withColumn("_r", F.row_number().over(W.partitionBy("question_id", "ticker").orderBy("gap", "year"))).filter("_r = 1").select("question_id", "ticker", "year")
    used = best.groupBy("question_id").agg(F.countDistinct("year").alias("used"))
    asked = years.groupBy("question_id").agg(F.countDistinct("year").alias("asked"))
    return best.join(used.join(asked.hint("merge"), "question_id").filter("used = asked").select("question_id"), "question_id", "left_semi")


# -- similarity -------------------------------------------------------------------------------------


def _grams(text_col: str) -> Column:
    """The trigrams of a text, as hashes."""
    return F.transform(T.grams(T.words(F.col(text_col))), lambda x: F.xxhash64(x))


def _signature(found: np.ndarray) -> bytes:
    return hashlib.sha256(found.tobytes()).digest()


def _sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each place of the lowest bits of a gram, set where an odd number of grams has it; as many bits as the power of two up to the set's size, 64 at least."""
    bits = max(64, 1 << (max(len(found), 1).bit_length() - 1))
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signed(threshold: float, frequent: np.ndarray, place: np.ndarray) -> Callable[[Column], Column]:
    """Of sets of grams: how many, a signature, the sketch, and the first grams in the common order, as many as two sets at the threshold can't both lack."""

    def prefix(found: np.ndarray) -> np.ndarray:
        keep = len(found) - int(np.ceil(len(found) * threshold - 1e-9)) + 1
        if not len(frequent):
            return found[:keep]
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        return found[np.argsort(np.where(frequent[at] == found, place[at], 0), kind="stable")[:keep]]

    @F.pandas_udf("n int, sig binary, sketch array<long>, prefix array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sets in batches:
            found = [np.sort(np.asarray(s, np.int64)) for s in sets]
            yield pd.DataFrame({"n": [len(x) for x in found], "sig": [_signature(x) for x in found], "sketch": [_sketch(x) for x in found], "prefix": [prefix(x) for x in found]})

    return signed


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams of a part of the rows (_id, text), of which equal texts count once; FREQUENT at most, sorted, and their places in the common order, the rarest first."""
    part = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(PART)) == 0)
    once = written(part.groupBy(F.xxhash64(T.words(F.col("text"))).alias("_same")).agg(F.min("_id").alias("_id")).select("_id"), "once")
    some = part.join(hinted(once, once.count(), 1_000_000), "_id", "left_semi")
    counts = written(some.select(F.explode(_grams("text")).alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    have, least = 0, None
    for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        have += r["n"]
        if have > FREQUENT:
            break
        least = r["c"]
    rows = sorted((r["c"], r["h"]) for r in counts.filter(F.col("c") >= least).collect()) if least else []
    found = np.array([h for _, h in rows], np.int64)
    order = np.argsort(found)
    return found[order], order + 1


def gram_classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(class_id, n, sig, sketch, prefix of each distinct set of trigrams; _id, class_id of each row) of rows (_id, text).

    Sets are not kept: what is written of them is about a tenth, and those that must be compared are cut again.
    """
    signed = _signed(threshold, *_frequent(rows))
    cut = rows.select("_id", _grams("text").alias("grams"), F.monotonically_increasing_id().alias("_no"))
    g = written(cut.select("_id", "_no", signed(F.col("grams")).alias("_s")).select("_id", "_no", "_s.*"), "signed")
    # an id that is null names no class; an id names one class
    first = written(g.groupBy("sig").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_no")).alias("x")).select("sig", F.col("x._id").alias("class_id"), F.col("x._no").alias("_first")), "classes")
    named = first.filter("class_id is not null").groupBy("class_id").agg(F.min("_first").alias("_no")).select("_no")
    # the rows that don't name their class are told by a number, and are fewer than the classes
    others = written(g.select("_no").join(named.hint("merge"), "_no", "left_anti"), "others")
    classes = g.join(hinted(others, others.count(), 1_000_000), "_no", "left_anti").select(F.col("_id").alias("class_id"), "n", "sig", "sketch", "prefix")
    return classes, g.select("_id", "sig").join(first.select("sig", "class_id").hint("merge"), "sig").drop("sig")


def close_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b), na, nb of the pairs of classes that may reach the threshold; no pair that does is lost.

    Sets of n grams that reach the threshold share one of their first n - ceil(t * n) + 1 grams in any common order. Here the order is by hash, frequent
    grams last; which are frequent is estimated from a part of the rows and touches the cost alone. Only those prefixes meet. Sizes must fit, and
    what is left after the places where two sets meet first must hold all that they share. Then sketches meet: where bits differ, so do the sets, by
    as many grams at least.
    """
    some = classes.filter("n > 0")
    side = lambda s: some.select(F.col("class_id").alias(s), F.col("n").alias(f"n{s}"), F.posexplode("prefix").alias(f"i{s}", "h"))
    both = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both)
    pairs = written(side("a").join(side("b").hint("merge"), "h").filter(fits).select("a", "b", "na", "nb").distinct(), "pairs")

    def folded(x: Column, other: Column) -> Column:
        """A sketch of twice as many bits as the other's has what it would have with as many."""
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    xa, xb = F.col("xa"), F.col("xb")
    differ = F.aggregate(F.zip_with(folded(xa, xb), folded(xb, xa), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    ga, gb = (some.select(F.col("class_id").alias(s), F.col("sketch").alias(f"x{s}")) for s in ("a", "b"))
    met = pairs.join(ga.hint("merge"), "a").join(gb.hint("merge"), "b")
    # sketches of other sizes, at a threshold under a half, tell nothing
    return written(met.filter(F.coalesce(differ <= F.col("na") + F.col("nb") - 2 * both, F.lit(True))).select("a", "b", "na", "nb"), "close")


def _tiles(pairs: DataFrame, grams: int, rows: int, most: int) -> DataFrame:
    """a, b, p, q: pairs (a, b, na, nb) with the numbers of the two blocks whose sets must meet for them.

    Classes go by a name that they share with those they meet, the least within two steps; a name with more grams or rows than a block
    holds has blocks of its own, the others are dealt to common ones. Names and blocks touch the cost alone: a pair of any two blocks has its tile.
    """
    end = lambda x, y: F.struct(F.col(x).alias("class_id"), F.col(f"n{x}").alias("n"), F.col(y).alias("other"))
    ends = pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.*")
    near = written(ends.groupBy("class_id").agg(F.max("n").alias("n"), F.min(F.least("class_id", "other")).alias("name")), "near")
    far = ends.select("class_id", "other").join(near.select(F.col("class_id").alias("other"), "name").hint("merge"), "other").groupBy("class_id").agg(F.min("name").alias("name"))
    seats = written(near.select("class_id", "n").join(far.hint("merge"), "class_id"), "seats")
    parts = seats.groupBy("name").agg(F.ceil(F.greatest(F.sum("n") / grams, F.count("*") / rows)).alias("k"))
    common = max(1, -(-(seats.agg(F.sum("n")).first()[0] or 0) // grams), -(-pairs.count() // most))
    block = F.when(F.col("k") <= 1, F.pmod(F.xxhash64("name"), F.lit(common))).otherwise(F.xxhash64("name", F.pmod(F.xxhash64("class_id"), F.col("k"))))
    placed = written(seats.join(parts.hint("merge"), "name").select("class_id", block.alias("block")), "blocks")
    pa, pb = (placed.select(F.col("class_id").alias(s), F.col("block").alias(f"b{s}")) for s in ("a", "b"))
    met = pairs.select("a", "b").join(pa.hint("merge"), "a").join(pb.hint("merge"), "b")
    return written(met.select("a", "b", F.least("ba", "bb").alias("p"), F.greatest("ba", "bb").alias("q")), "tiles")


def _verified(threshold: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function over the pairs of a tile and its sets (class_id, sig, grams) that gives the pairs at the threshold, with their Jaccard."""

    def run(_: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        held, out = {}, []
        for i, sig, grams in zip(sets["class_id"].tolist(), sets["sig"].tolist(), sets["grams"].tolist(), strict=True):
            found = np.sort(np.asarray(grams, np.int64))
            if _signature(found) == bytes(sig):  # an id may have other rows
                held[i] = found
        for a, others in pairs.groupby("a", sort=False)["b"]:
            mine, met = held[a], [held[b] for b in others.tolist()]
            n, every = np.array([len(x) for x in met]), np.concatenate(met)
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            jaccard = both / (len(mine) + n - both)
            out.append(pd.DataFrame({"a": a, "b": others.to_numpy(), "jaccard": jaccard})[jaccard >= threshold - 1e-12])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "jaccard": []})

    return run


def near_duplicates(rows: DataFrame, id_col: str, text_col: str, threshold: float = NEAR, grams: int = 1 << 18, block: int = 512, most: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard of the pairs of different trigram sets at the threshold, by their class ids; id_col, class_id of each row).

    Equal sets are one class, named by its smallest id, so that copies aren't expanded into pairs. Rows without words are one class without pairs.
    Sets travel to blocks and not to pairs: to two blocks that have pairs, each set that is in one goes once. A block has about so many grams, or
    rows, and common blocks about so many pairs. The rows are read three times.
    """
    texts = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    classes, members = gram_classes(texts, threshold)
    pairs = _tiles(close_classes(classes, threshold), grams, block, most)
    to = lambda c: F.struct(F.col(c).alias("class_id"), "p", "q")
    goes = pairs.select(F.explode(F.array(to("a"), to("b"))).alias("x")).groupBy("x.class_id").agg(F.collect_set(F.struct("x.p", "x.q")).alias("to"))
    goes = written(goes.join(classes.select("class_id", "sig").hint("merge"), "class_id"), "goes")
    sets = texts.withColumnRenamed("_id", "class_id").join(hinted(goes, goes.count(), 1_000_000), "class_id").select("class_id", "sig", "to", _grams("text").alias("grams"))
    sets = sets.select("class_id", "sig", "grams", F.explode("to").alias("x")).select("class_id", "sig", "grams", "x.*")
    kind = classes.schema["class_id"].dataType.simpleString()
    met = pairs.groupBy("p", "q").cogroup(sets.groupBy("p", "q")).applyInPandas(_verified(threshold), f"a {kind}, b {kind}, jaccard double")
    return written(met, "similar"), members.withColumnRenamed("_id", id_col)


def term_similarity(left: DataFrame, right: DataFrame, top: int = 3, left_rows: int = 512, right_rows: int = 4096, chars: int = 16 << 20) -> DataFrame:
    """group, left_id, right_id, score, rank: the top other windows on the right of each on the left, by shared terms over the root of both numbers; ties by id, last first.

    Every pair of a group is scored. Each side of a group is dealt into blocks, bounded by rows and by characters; a task has one block of each
    side and passes on the best of each left window, so that pairs are never rows. Rows of one id and group are one window.
    """
    terms = F.array_join(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1), lambda w: ~w.isin(*T.STOPWORDS))), " ")
    number = lambda d, rows, name: d.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.length("text")) / chars), F.lit(1)).cast("int").alias(name))
    blocks = written(number(left, left_rows, "_nl").join(number(right, right_rows, "_nr").hint("merge"), "group"), "blocks")
    n_blocks = blocks.count()

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        # new names for the columns: both sides may come from one table
        met = d.filter("id is not null").select(F.col("group").alias("group"), F.col("id").alias("id"), terms.alias("terms")).filter("terms <> ''").join(hinted(blocks, n_blocks, 100_000), "group")
        return met.select("group", "id", "terms", F.pmod(F.xxhash64("id"), F.col(f"_n{own}")).cast("int").alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(f"_{other}"))

    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    out = f"`group` {kinds['group']}, left_id {kinds['id']}, right_id {kinds['id']}, shared long, nl long, nr long"
    key = ["group", "_l", "_r"]
    met = dealt(left, "l", "r").groupBy(*key).cogroup(dealt(right, "r", "l").groupBy(*key)).applyInPandas(most_shared(top), out)
    scored = met.select("group", "left_id", "right_id", F.round(F.col("shared") / F.sqrt(F.col("nl").cast("double") * F.col("nr")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("group", "left_id").orderBy(F.desc("score"), F.desc("right_id")))).filter(F.col("rank") <= top)


def benchmark_overlap(texts: DataFrame, gold: DataFrame, facts: DataFrame, gold_facts: DataFrame) -> DataFrame:
    """example_id and reasons, sorted and joined, of examples that overlap the gold set.

    A text is compared as a whole (exact_text, near_text: Jaccard of the sets of trigrams) and by what it holds (gold_passage: the
    share of a gold text's trigrams). Either way it lacks n - ceil(t * n) of the gold text's trigrams at most, so of any MORE above
    that number it has MORE: the rarest of the gold texts' own trigrams are probed with all of the texts, and pairs that share
    as many are verified. A fact meets each label of its source and value once. The gold tables are the query set and smaller than the examples.
    """
    grams = lambda c: F.transform(T.grams(T.words(F.col(c))), lambda x: F.xxhash64(x))
    fp = written(texts.select("example_id", T.fingerprint(F.col("text")).alias("fp"), grams("text").alias("g")), "texts")
    gfp = gold.select(T.fingerprint(F.col("text")).alias("fp"), grams("text").alias("gg")).dropDuplicates(["fp"]).filter(F.size("gg") > 0)
    gfp = written(gfp.withColumn("gold", F.monotonically_increasing_id()), "gold")
    exact = fp.join(hinted(gfp.select("fp"), gfp.count(), 1_000_000), "fp", "left_semi").select("example_id", F.lit(EXACT).alias("why"))
    listed = gfp.select("gold", F.explode("gg").alias("h"))
    times = listed.groupBy("h").agg(F.count("*").alias("c"))
    ranked = listed.join(times.hint("merge"), "h").groupBy("gold").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("x"))
    lacks = (F.size("x") - F.ceil(F.size("x") * OVERLAP - 1e-9)).cast("int")
    chosen = ranked.select("gold", F.slice("x", F.lit(1), lacks + MORE).alias("x"), lacks.alias("lacks"))
    probes = written(chosen.select("gold", (F.size("x") - F.col("lacks")).alias("least"), F.explode("x.h").alias("h")), "probes")
    hits = fp.select("example_id", F.explode("g").alias("h")).join(hinted(probes, probes.count(), 2_000_000), "h").groupBy("example_id", "gold").agg(F.count("*").alias("c"), F.first("least").alias("least"))
    met = written(hits.filter("c >= least").select("example_id", "gold"), "met")
    pairs = fp.select("example_id", "g").join(hinted(met, met.count(), 1_000_000), "example_id").join(gfp.select("gold", "gg").hint("merge"), "gold")
    both = F.size(F.array_intersect("g", "gg"))
    held = pairs.select("example_id", both.alias("both"), F.size("g").alias("n"), F.size("gg").alias("m"))
    near = held.select("example_id", (F.when(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= OVERLAP, NEAR_TEXT).otherwise(0) + F.when(F.col("both") / F.col("m") >= OVERLAP, PASSAGE).otherwise(0)).alias("why")).filter("why > 0")
    kinds = written(gold_facts.select("source", "label", "value", "period").distinct(), "kinds")
    same = facts.join(hinted(kinds, n_kinds := kinds.count(), 1_000_000), ["source", "label", "value", "period"], "left_semi").select("example_id", F.lit(SAME_FACT).alias("why"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    labels = kinds.select("source", "value", words(F.col("label")).alias("_g")).distinct()
    said = facts.select("example_id", "source", "value", words(F.col("label")).alias("_w")).alias("f")
    g = hinted(labels, n_kinds, 1_000_000).alias("g")
    alike = (F.col("f.source") == F.col("g.source")) & (F.col("f.value") == F.col("g.value")) & (F.size(F.array_intersect("_w", "_g")) >= LABEL_SHARE * F.size("_w"))
    likely = said.join(g, alike, "left_semi").select("example_id", F.lit(LIKELY).alias("why"))
    every = exact.unionByName(near).unionByName(same).unionByName(likely).groupBy("example_id").agg(F.bit_or("why").alias("why"))
    return every.select("example_id", F.concat_ws(",", *[F.when(F.col("why").bitwiseAND(F.lit(bit)) > 0, name) for bit, name in REASONS]).alias("reasons"))


def stored_against_current(current: DataFrame, stored: DataFrame) -> DataFrame:
    """id, reason of stored reviews that can't be used: unknown id, repeated, or of another version of the row."""
    s = stored.groupBy("id").agg(F.count("*").alias("n"), F.min("row_hash").alias("stored_hash"))
    met = s.join(current.hint("merge"), "id", "left")
    reason = F.when(F.col("row_hash").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("row_hash") != F.col("stored_hash"), "stale")
    return met.select("id", reason.alias("reason")).filter("reason is not null")


def reduction(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0)).otherwise(F.round((before - after) * 100 / F.nullif(before, F.lit(0.0)), 2))


# -- queries ----------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "10K").otherwise("TRANSCRIPT")
    ext = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 13 == 0, "html").otherwise("pdf")).otherwise("html")
    name = F.concat(F.upper("source"), F.lit("_"), (2000 + F.expr("doc_id div 20") % 97).cast("string"), F.when(F.col("doc_id") % 11 == 0, "-").otherwise("_"), kind, F.lit("."), ext)
    return d.select("doc_id", F.when(F.col("doc_id") % 17 == 0, "misc").otherwise(F.col("source")).alias("folder"), name.alias("name"), F.coalesce("text", F.lit("")).alias("content"))


_FILES = "files AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'misc' ELSE source END AS folder, upper(source) || '_' || (2000 + (doc_id // 20) % 97) || CASE WHEN doc_id % 11 = 0 THEN '-' ELSE '_' END || CASE WHEN doc_id % 2 = 0 THEN '10K' ELSE 'TRANSCRIPT' END || '.' || CASE WHEN doc_id % 2 = 0 AND doc_id % 13 <> 0 THEN 'pdf' ELSE 'html' END AS name, coalesce(text, '') AS content FROM documents)"


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0")
    return d.select(F.col("source").alias("ticker"), (2019 + F.col("doc_id") % 5).cast("int").alias("fiscal_year"), F.when(F.expr("doc_id div 20") % 2 == 0, "10-K").otherwise("transcript").alias("doc_type")).distinct()


_AVAILABLE = "available AS (SELECT DISTINCT source AS ticker, (2019 + doc_id % 5)::INT AS fiscal_year, CASE WHEN (doc_id // 20) % 2 = 0 THEN '10-K' ELSE 'transcript' END AS doc_type FROM documents WHERE doc_id % 3 <> 0)"


def asked_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("src"), (F.col("doc_id") * 7 % 23).cast("string")).alias("ticker"), (2018 + F.col("doc_id") % 7).cast("int").alias("fiscal_year"), F.when(F.col("doc_id") % 3 == 0, "10-K").when(F.col("doc_id") % 3 == 1, "transcript").alias("doc_type"))


_ASKED = "asked AS (SELECT doc_id AS question_id, 'src' || (doc_id * 7 % 23) AS ticker, (2018 + doc_id % 7)::INT AS fiscal_year, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN 'transcript' END AS doc_type FROM documents)"


def q_source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(files(spark, sf_dir)).select("folder", "name", "ticker", "fiscal_year", "doc_type", "reason")


def q_inventory_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected_minus(available(spark, sf_dir))


def q_source_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight(files(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("%PDF-"), "content")).otherwise(F.col("content"))).withColumnRenamed("doc_id", "id"))


def q_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("name", F.sha2("content", 256).alias("source_hash")).distinct()


def q_incremental_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of two thirds of the texts, of which some were parsed with another prompt and some gave nothing."""
    now = files(spark, sf_dir).select("doc_id", cache_key(F.lit("v2"), F.sha2("content", 256), F.lit("standard"), F.lit("parser-1"), F.lit("prompt-3")).alias("key"))
    old = files(spark, sf_dir).filter("doc_id % 3 <> 0").select("doc_id", cache_key(F.lit("v2"), F.sha2("content", 256), F.lit("standard"), F.lit("parser-1"), F.when(F.col("doc_id") % 5 == 0, "prompt-2").otherwise("prompt-3")).alias("key"), (F.col("doc_id") % 7).alias("n_pages"))
    return to_parse(now, old.select("key", "n_pages")).select("doc_id", "key")


def q_manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash is of the number of names and the sum of their digests' first 52 bits, which any order of the sources gives. Without sources years is null."""
    f = inventory(files(spark, sf_dir)).filter("reason is null")
    part = F.conv(F.substring(F.sha2("name", 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return f.agg(F.count("*").alias("sources"), F.countDistinct("ticker").alias("companies"), F.when(F.count("fiscal_year") > 0, F.array_join(F.array_sort(F.collect_set("fiscal_year")).cast("array<string>"), ",")).alias("years"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string")), 256).alias("sources_hash"))


def q_manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, parents and vectors (here the documents of even number) by id: those that one side lacks."""
    c = V.chunks(spark, sf_dir).select("doc_id").distinct().withColumn("lexical", F.lit(True))
    v = V.table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select("doc_id", F.lit(True).alias("vector"))
    met = c.join(v.hint("merge"), "doc_id", "full_outer").filter("lexical is null or vector is null")
    return met.select("doc_id", F.when(F.col("vector").isNull(), "no vector").otherwise("no text").alias("reason"))


def q_index_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = available(spark, sf_dir)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return a.groupBy("ticker").agg(joined(F.col("fiscal_year").cast("string")).alias("years"), joined(F.col("doc_type")).alias("types"), joined(F.concat_ws(":", F.col("fiscal_year").cast("string"), "doc_type")).alias("available"))


def q_merge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir).select("example_id", "query_type")
    return merge_inputs(e.filter("example_id % 3 <> 0"), e.filter("example_id % 5 = 0"), key="example_id")


def q_facts_sources_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against orders: the mismatch of each item whose order is missing or of another status."""
    line = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    o = V.table(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select("o_orderkey", "o_orderstatus")
    met = line.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = F.when(F.col("o_orderkey").isNull(), "unknown source").when(~F.col("o_orderstatus").isin("P") & (F.col("o_orderstatus") != F.col("l_linestatus")), "status mismatch")
    return met.groupBy(reason.alias("reason"), (F.col("l_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("rows"))


def q_group_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's first requested group of each question."""
    c, g = V.chunks(spark, sf_dir), V.question_groups(spark, sf_dir)
    met = g.join(c.hint("merge"), (g["ticker"] == c["ticker"]) & (g["doc_type"].isNull() | (g["doc_type"] == c["doc_type"])))
    return met.groupBy("question_id", "child_id").agg(F.min("grp_ord").alias("grp_ord"))


def q_missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_sources(asked_scopes(spark, sf_dir), available(spark, sf_dir))


def q_missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a comparison without a chunk of 60 words or more."""
    c, g = V.chunks(spark, sf_dir).filter(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)) >= 60).select("ticker", "doc_type").distinct(), V.question_groups(spark, sf_dir).withColumn("ticker", F.when(F.col("question_id") % 6 == 0, "srcX").otherwise(F.col("ticker")))
    return g.join(c.hint("merge"), (g["ticker"] == c["ticker"]) & (g["doc_type"].isNull() | (g["doc_type"] == c["doc_type"])), "left_anti").select("question_id", "grp_ord", "ticker")


def q_doc_type_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = ambiguous(available(spark, sf_dir))
    return asked_scopes(spark, sf_dir).filter("doc_type is null").join(both.hint("merge"), ["ticker", "fiscal_year"], "left_semi").select("question_id")


def q_latest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_available(available(spark, sf_dir))


def q_nearest_year_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions at places that follow from the numbers of the documents."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    m = d.select("question_id", F.explode(F.array(*[F.struct(F.lit(f"co{i}").alias("ticker"), ((F.col("question_id") * (3 + i) + 11 * i) % 90).alias("at")) for i in range(2)])).alias("m")).select("question_id", "m.*")
    y = d.select("question_id", F.explode(F.array(*[F.struct(F.lit(2020 + i).alias("year"), ((F.col("question_id") * (5 + i) + 17 * i) % 90).alias("year_at")) for i in range(2)])).alias("y")).select("question_id", "y.*")
    return nearest_years(m, y)


def q_period_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest and the second-newest year of each company and metric."""
    f = V.facts(spark, sf_dir).dropDuplicates(["ticker", "metric", "fiscal_year"])
    line = W.partitionBy("ticker", "metric", "unit").orderBy(F.desc("fiscal_year"))
    return f.withColumn("older_year", F.lead("fiscal_year").over(line)).withColumn("_r", F.row_number().over(line)).filter("_r = 1 and older_year is not null").select("ticker", "metric", F.col("fiscal_year").alias("newer_year"), "older_year")


def q_cross_company_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of companies on the same year, metric and unit, with the winner (null: equal values). A year and metric have one row a nation, so 300 pairs at any size of the tables."""
    f = written(V.facts(spark, sf_dir), "facts")
    a, b = (f.select("fiscal_year", "metric", "unit", F.col("ticker").alias(f"{s}_ticker"), F.col("base_value").alias(f"{s}_value")) for s in ("left", "right"))
    met = a.join(b.hint("merge"), ["fiscal_year", "metric", "unit"]).filter("left_ticker < right_ticker")
    return met.select("fiscal_year", "metric", "left_ticker", "right_ticker", F.when(F.col("left_value") > F.col("right_value"), F.col("left_ticker")).when(F.col("left_value") < F.col("right_value"), F.col("right_ticker")).alias("winner"))


def q_synthesis_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document, the query set, against all others of its source and language, those of the query set too."""
    e = V.segments(spark, sf_dir).select(F.concat_ws("-", "ticker", "doc_type").alias("group"), F.col("doc_id").alias("id"), "text")
    return term_similarity(e.filter("id % 100 = 0"), e).select("group", "left_id", "right_id", "score", F.col("rank").cast("long").alias("rank"))


def q_near_duplicate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of its trigram set, and the number of other classes at the threshold."""
    pairs, members = near_duplicates(V.segments(spark, sf_dir), "doc_id", "text")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends.hint("merge"), "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("example_id"), (F.col("o_custkey") % 40).alias("source"), F.col("o_orderpriority").alias("label"), F.floor(F.col("o_totalprice") / 5000).cast("long").alias("value"), F.year("o_orderdate").alias("period"))


def q_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and facts of the orders; gold: the items, every fiftieth document, and facts of orders of other customers."""
    t = V.segments(spark, sf_dir).select(F.col("doc_id").alias("example_id"), "text")
    gold = V.table(spark, sf_dir, "benchmark").select("text").unionByName(t.filter("example_id % 50 = 0").select("text"))
    f = _order_facts(spark, sf_dir)
    return benchmark_overlap(t, gold, f.filter("example_id % 7 <> 0"), f.filter("example_id % 97 = 0"))


def q_stale_review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir)
    now = e.select(F.col("example_id").alias("id"), F.sha2("question", 256).alias("row_hash")).filter("id % 11 <> 0")
    then = e.select(F.col("example_id").alias("id"), F.sha2(F.when(F.col("example_id") % 6 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")), 256).alias("row_hash"))
    return stored_against_current(now, then.unionByName(then.filter("id % 8 = 0")))


def q_gold_answer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers against gold rows by id, with the fields that differ."""
    e = V.examples(spark, sf_dir)
    gold = e.select("example_id", F.col("query_type").alias("category"), F.sha2("question", 256).alias("q"))
    saved = e.filter("example_id % 9 <> 0").select("example_id", F.when(F.col("example_id") % 10 == 0, "other").otherwise(F.col("query_type")).alias("c2"), F.when(F.col("example_id") % 4 == 0, "x").otherwise(F.sha2("question", 256)).alias("q2"))
    met = gold.join(saved.hint("merge"), "example_id", "left")
    differ = F.array_compact(F.array(F.when(F.col("c2").isNull(), "missing"), F.when(F.col("category") != F.col("c2"), "category"), F.when(F.col("q") != F.col("q2"), "question")))
    return met.select("example_id", F.array_join(differ, ",").alias("mismatches"))


def q_run_compare_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of each user: events of even and of odd number."""
    e = V.table(spark, sf_dir, "events")
    run = lambda r, n: e.filter(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.count("*").cast("double").alias(f"{n}_calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).cast("double").alias(f"{n}_tokens"))
    met = run(0, "before").join(run(1, "after"), "user_id")
    return met.select("user_id", reduction(F.col("before_calls"), F.col("after_calls")).alias("calls_reduction"), reduction(F.col("before_tokens"), F.col("after_tokens")).alias("tokens_reduction"))


def q_question_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's expected source against the inventory's for its key."""
    a = asked_scopes(spark, sf_dir).filter("doc_type is not null").withColumn("expected", F.when(F.col("question_id") % 4 == 0, F.concat_ws("_", "ticker", "doc_type")))
    have = available(spark, sf_dir).withColumn("actual", F.concat_ws("_", "ticker", "doc_type"))
    return a.join(have.hint("merge"), ["ticker", "fiscal_year", "doc_type"], "left").select("question_id", F.col("expected").eqNullSafe(F.col("actual")).alias("matches"))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}
_INV = rf"""{_FILES}, cut AS (SELECT *, regexp_extract(name, '{FILE}', 1) AS t, regexp_extract(name, '{FILE}', 2) AS y, regexp_extract(name, '{FILE}', 3) AS k, regexp_extract(name, '{FILE}', 4) AS ext FROM files),
inv AS (SELECT folder, name, nullif(t, '') AS ticker, nullif(y, '')::INT AS fiscal_year, nullif(k, '') AS doc_type, CASE WHEN t = '' THEN 'name not recognised' WHEN k = '10K' AND ext <> 'pdf' THEN 'extension not allowed' WHEN upper(folder) <> t THEN 'folder and ticker differ' WHEN count(*) OVER (PARTITION BY t, y, k) > 1 THEN 'duplicate source' END AS reason FROM cut)"""
_FOLDED = r"trim(regexp_replace(lower(translate(coalesce(text, ''), '‘’“”–—' || chr(160), '''''" + '""' + r"-- ')), '\s+', ' ', 'g'))"


def _gram_sql(source: str, id_col: str, tag: str) -> str:
    return rf"""w{tag} AS (SELECT {id_col} AS id, regexp_extract_all({_FOLDED}, '([a-z0-9]+)', 1) AS w FROM {source}), p{tag} AS (SELECT id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w{tag} WHERE len(w) > 0),
e{tag} AS (SELECT DISTINCT id, array_to_string(w[p : p + 2], ' ') AS g FROM p{tag}), n{tag} AS (SELECT id, count(*) AS n FROM e{tag} GROUP BY id)"""


ORACLES = {
    "source_inventory": f"WITH {_INV} SELECT * FROM inv",
    "inventory_missing": f"WITH {_AVAILABLE} SELECT * FROM (SELECT DISTINCT ticker FROM available), (SELECT DISTINCT fiscal_year FROM available), (SELECT DISTINCT doc_type FROM available) EXCEPT SELECT * FROM available",
    "source_preflight": rf"WITH {_FILES}, c AS (SELECT doc_id AS id, name, CASE WHEN doc_id % 4 = 0 THEN '%PDF-' || content ELSE content END AS content FROM files) SELECT id, concat_ws(',', CASE WHEN strlen(content) < 1024 THEN 'too small' END, CASE WHEN ends_with(name, '.pdf') AND NOT starts_with(content, '%PDF-') THEN 'bad signature' END, CASE WHEN len(regexp_extract_all(content, '(\S+)', 1)) < 100 THEN 'too few words' END, CASE WHEN NOT regexp_matches(lower(content), '\b(operator|question|the|de|der)\b') THEN 'no cue' END) AS reasons FROM c",
    "source_hash": f"WITH {_FILES} SELECT DISTINCT name, sha256(content) AS source_hash FROM files",
    "incremental_parse": f"""WITH {_FILES}, k AS (SELECT doc_id, sha256('["v2","' || sha256(content) || '","standard","parser-1","prompt-3"]') AS key, sha256('["v2","' || sha256(content) || '","standard","parser-1","' || CASE WHEN doc_id % 5 = 0 THEN 'prompt-2' ELSE 'prompt-3' END || '"]') AS old FROM files) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT old FROM k WHERE doc_id % 3 <> 0 AND doc_id % 7 > 0)""",
    "manifest_build": f"WITH {_INV} SELECT count(*) AS sources, count(DISTINCT ticker) AS companies, array_to_string(list_sort(list(DISTINCT fiscal_year)), ',') AS years, sha256(count(*) || '|' || coalesce(sum(('0x' || substr(sha256(name), 1, 13))::BIGINT), 0)::HUGEINT) AS sources_hash FROM inv WHERE reason IS NULL",
    "manifest_check": V.with_views("chunks") + ", c AS (SELECT DISTINCT doc_id FROM chunks), v AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3) SELECT coalesce(c.doc_id, v.doc_id) AS doc_id, CASE WHEN v.doc_id IS NULL THEN 'no vector' ELSE 'no text' END AS reason FROM c FULL JOIN v ON c.doc_id = v.doc_id WHERE c.doc_id IS NULL OR v.doc_id IS NULL",
    "index_catalogue": f"WITH {_AVAILABLE} SELECT ticker, array_to_string(list_sort(list(DISTINCT fiscal_year::VARCHAR)), ',') AS years, array_to_string(list_sort(list(DISTINCT doc_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT fiscal_year || ':' || doc_type)), ',') AS available FROM available GROUP BY ticker",
    "merge_inputs": V.with_views("examples") + ", u AS (SELECT example_id, query_type FROM examples WHERE example_id % 3 <> 0 UNION ALL SELECT example_id, query_type FROM examples WHERE example_id % 5 = 0) SELECT *, count(*) OVER (PARTITION BY example_id) - 1 AS duplicates FROM u",
    "facts_sources_join": "SELECT CASE WHEN o_orderkey IS NULL THEN 'unknown source' WHEN o_orderstatus <> 'P' AND o_orderstatus <> l_linestatus THEN 'status mismatch' END AS reason, l_orderkey % 100 AS bucket, count(*) AS rows FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) ON l_orderkey = o_orderkey GROUP BY ALL",
    "group_match_join": V.with_views("question_groups", "chunks") + " SELECT question_id, child_id, min(grp_ord) AS grp_ord FROM question_groups g JOIN chunks c ON g.ticker = c.ticker AND (g.doc_type IS NULL OR g.doc_type = c.doc_type) GROUP BY question_id, child_id",
    "missing_sources": f"WITH {_AVAILABLE}, {_ASKED} SELECT question_id, ticker, fiscal_year, doc_type FROM asked a WHERE NOT EXISTS (SELECT 1 FROM available v WHERE v.ticker = a.ticker AND v.fiscal_year = a.fiscal_year AND (a.doc_type IS NULL OR a.doc_type = v.doc_type))",
    "missing_groups": V.with_views("question_groups", "chunks") + r", c AS (SELECT DISTINCT ticker, doc_type FROM chunks WHERE len(regexp_extract_all(text, '(\S+)', 1)) >= 60), g AS (SELECT question_id, grp_ord, CASE WHEN question_id % 6 = 0 THEN 'srcX' ELSE ticker END AS ticker, doc_type FROM question_groups) SELECT question_id, grp_ord, ticker FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ticker = g.ticker AND (g.doc_type IS NULL OR g.doc_type = c.doc_type))",
    "doc_type_ambiguity": f"WITH {_AVAILABLE}, {_ASKED} SELECT question_id FROM asked WHERE doc_type IS NULL AND (ticker, fiscal_year) IN (SELECT (ticker, fiscal_year) FROM available GROUP BY ticker, fiscal_year HAVING count(*) = 2)",
    "latest_available": f"WITH {_AVAILABLE} SELECT ticker, doc_type, max(fiscal_year) AS fiscal_year FROM available GROUP BY ticker, doc_type",
    "nearest_year_pairing": "WITH m AS (SELECT doc_id AS q, 'co' || i AS ticker, (doc_id * (3 + i) + 11 * i) % 90 AS at_ FROM documents, range(2) r(i)), y AS (SELECT doc_id AS q, (2020 + i)::INT AS year, (doc_id * (5 + i) + 17 * i) % 90 AS yat FROM documents, range(2) r(i)), b AS (SELECT m.q, ticker, year FROM m JOIN y ON m.q = y.q WHERE abs(at_ - yat) <= 28 QUALIFY row_number() OVER (PARTITION BY m.q, ticker ORDER BY abs(at_ - yat), year) = 1) SELECT q AS question_id, ticker, year FROM b WHERE q IN (SELECT q FROM b GROUP BY q HAVING count(DISTINCT year) = 2)",
    "period_pairs": V.with_views("facts") + " SELECT ticker, metric, fiscal_year AS newer_year, older_year FROM (SELECT *, lead(fiscal_year) OVER w AS older_year, row_number() OVER w AS r FROM facts WINDOW w AS (PARTITION BY ticker, metric, unit ORDER BY fiscal_year DESC)) WHERE r = 1 AND older_year IS NOT NULL",
    "cross_company_join": V.with_views("facts") + " SELECT a.fiscal_year, a.metric, a.ticker AS left_ticker, b.ticker AS right_ticker, CASE WHEN a.base_value > b.base_value THEN a.ticker WHEN a.base_value < b.base_value THEN b.ticker END AS winner FROM facts a JOIN facts b ON a.fiscal_year = b.fiscal_year AND a.metric = b.metric AND a.unit = b.unit AND a.ticker < b.ticker",
    "synthesis_pairs": V.with_views("segments") + ", t AS (SELECT DISTINCT ticker || '-' || doc_type AS \"group\", doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '([a-z]{4,})', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))) AS t FROM segments), n AS (SELECT id, count(*) AS n FROM t GROUP BY id), s AS (SELECT a.\"group\", a.id AS left_id, b.id AS right_id, round(count(*) / sqrt(any_value(x.n)::DOUBLE * any_value(y.n)), 9) AS score FROM t a JOIN t b ON a.\"group\" = b.\"group\" AND a.t = b.t AND a.id % 100 = 0 AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY a.\"group\", a.id, b.id) SELECT *, row_number() OVER (PARTITION BY \"group\", left_id ORDER BY score DESC, right_id DESC) AS rank FROM s QUALIFY rank <= 3",
    "near_duplicate_join": "WITH " + _gram_sql("documents", "doc_id", "") + f", sig AS (SELECT w.id, sha256(coalesce(string_agg(g, '|' ORDER BY g), '')) AS s FROM w LEFT JOIN e USING (id) GROUP BY w.id), cl AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sig), er AS (SELECT e.* FROM e WHERE id IN (SELECT class_id FROM cl)), c AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM er a JOIN er b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*) > 3), l AS (SELECT a, count(*) AS links FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i / (x.n + y.n - i) >= {NEAR} GROUP BY a) SELECT id AS doc_id, class_id, coalesce(links, 0) AS links FROM cl LEFT JOIN l ON a = class_id",
    "benchmark_overlap": f"WITH t AS (SELECT doc_id AS example_id, text FROM documents), gold AS (SELECT row_number() OVER () AS gid, text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM t WHERE example_id % 50 = 0)), "
    + _gram_sql("t", "example_id", "1") + ", " + _gram_sql("gold", "gid", "2")
    + f""", x AS (SELECT DISTINCT w1.id AS example_id, 'exact_text' AS reason FROM w1 JOIN w2 ON len(w2.w) > 0 AND array_to_string(w1.w, ' ') = array_to_string(w2.w, ' ')), c AS (SELECT e1.id AS a, e2.id AS b, count(*) AS i FROM e1 JOIN e2 USING (g) GROUP BY ALL),
r AS (SELECT DISTINCT a AS example_id, 'near_text' AS reason FROM c JOIN n1 ON n1.id = a JOIN n2 ON n2.id = b WHERE i / (n1.n + n2.n - i) >= {OVERLAP} UNION SELECT DISTINCT a, 'gold_passage' FROM c JOIN n2 ON n2.id = b WHERE i / n2.n >= {OVERLAP}),
f AS (SELECT o_orderkey AS example_id, o_custkey % 40 AS source, o_orderpriority AS label, floor(o_totalprice / 5000)::BIGINT AS value, year(o_orderdate) AS period FROM orders), fe AS (SELECT * FROM f WHERE example_id % 7 <> 0), fg AS (SELECT * FROM f WHERE example_id % 97 = 0),
s AS (SELECT example_id, 'same_fact' AS reason FROM fe SEMI JOIN fg USING (source, label, value, period)), lw AS (SELECT fe.example_id, list_distinct(regexp_extract_all(lower(fe.label), '([a-z0-9]+)', 1)) AS a, list_distinct(regexp_extract_all(lower(fg.label), '([a-z0-9]+)', 1)) AS b FROM fe JOIN fg USING (source, value)),
l AS (SELECT example_id, 'probable_fact' AS reason FROM lw WHERE len(list_intersect(a, b)) >= {LABEL_SHARE} * len(a)), u AS (SELECT * FROM x UNION ALL SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l)
SELECT example_id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM u GROUP BY example_id""",
    "stale_review_join": V.with_views("examples") + " SELECT example_id AS id, CASE WHEN example_id % 11 = 0 THEN 'unknown' WHEN example_id % 8 = 0 THEN 'duplicate' ELSE 'stale' END AS reason FROM examples WHERE example_id % 11 = 0 OR example_id % 8 = 0 OR example_id % 6 = 0",
    "gold_answer_join": V.with_views("examples") + " SELECT example_id, CASE WHEN example_id % 9 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN example_id % 10 = 0 THEN 'category' END, CASE WHEN example_id % 4 = 0 THEN 'question' END) END AS mismatches FROM examples",
    "run_compare_join": "WITH r AS (SELECT user_id, event_id % 2 AS s, count(*)::DOUBLE AS c, sum(json_extract(props, '$.k')::BIGINT)::DOUBLE AS t FROM events GROUP BY ALL) SELECT b.user_id, round((b.c - a.c) * 100 / b.c, 2) AS calls_reduction, CASE WHEN b.t = 0 THEN CASE WHEN a.t = 0 THEN 0.0 END ELSE round((b.t - a.t) * 100 / b.t, 2) END AS tokens_reduction FROM r b JOIN r a ON a.user_id = b.user_id AND b.s = 0 AND a.s = 1",
    "question_source_check": f"WITH {_AVAILABLE}, {_ASKED} SELECT question_id, CASE WHEN question_id % 4 = 0 THEN a.ticker || '_' || a.doc_type END IS NOT DISTINCT FROM v.ticker || '_' || v.doc_type AS matches FROM asked a LEFT JOIN available v ON a.ticker = v.ticker AND a.fiscal_year = v.fiscal_year AND a.doc_type = v.doc_type WHERE a.doc_type IS NOT NULL",
}
