"""Near-duplicate groups by SimHash and the exact Jaccard coefficient of sets of five-word shingles.

A text's set has the 64-bit hashes of its shingles. Equal sets are one class. With ``fingerprints`` the links of
SimHash come first: fingerprints of simhash.py (three words, repeats included) that differ in at most two bits, by its
byte-position index, link the classes of their texts, whatever the coefficient. Then candidates are pairs of classes
that share a shingle of their prefixes. Two sets of n and m shingles that reach the threshold t share one of
their first ``n - ceil(t * n) + 1`` shingles in any order that is common to all, so no pair at the threshold
can be missed: fingerprints can't promise that, since sets at 0.8 differ in about ten bits of 64, and eight
changed bits may leave no byte equal. Pairs whose prefixes share too few to reach the threshold go before
any set is read. The order is by hash, with frequent shingles last so that prefixes hold rare ones; which
are frequent is estimated from a part of the texts and touches the cost alone, not the pairs.

Candidates are verified by the exact coefficient of the sets. Pairs of a list of at most ``longest`` classes are all
candidates. Of a longer list every class first meets the ``CENTRES`` with most of their prefix in long lists:
an edit puts rare shingles into a prefix, so these are the least edited, and what was copied from them meets
them at once. Then only the classes outside the list's largest group meet those of other groups. The
components are those of all pairs at the threshold and, with ``fingerprints``, of all links of SimHash.

Defined cases: texts of any length are read whole;
null and empty texts have the empty set and are copies of each other alone; texts of
fewer words than a shingle have one, the whole sequence; repeated rows have equal results; a null id
is kept, and counts as larger than any other id; only the named columns are read, so others can't clash; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_BYTES, hinted, row_key, small_batches, text_of, written
from .components import components
from .simhash import fingerprint
from .simhash import links as fingerprint_links

WORDS, THRESHOLD = 5, 0.8
#: One text in so many is looked at for frequent shingles; at most so many are told apart from the others.
PART, FREQUENT = 8, 20_000
#: Classes of a long list that all others of it meet first.
CENTRES = 4


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes. bytes.lower() and bytes.split() touch ASCII alone, as in fingerprints."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.array([], np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*[parts[i:] for i in range(words)], strict=False) if len(parts) >= words else [parts]
    return np.unique(np.array([digest(join(g)) for g in grams], np.uint64).view(np.int64))


def hashes_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hashes(t or "", words) for t in texts], dtype=object)

    return sets(text)


def prefix(found: np.ndarray, threshold: float, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order. frequent: sorted hashes; place: their places in that order."""
    n = len(found)
    keep = n - int(np.ceil(n * threshold - 1e-9)) + 1 if n else 0
    if not len(frequent):
        return found[:keep]
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    late = np.where(frequent[at] == found, place[at], 0)
    return found[np.lexsort((found, late))[:keep]]


def _marks(text: Column, words: int, threshold: float, frequent: np.ndarray, place: np.ndarray, fingerprints: bool) -> Column:
    @F.pandas_udf("sig long, fp long, n int, prefix array<long>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            sets = [hashes(t or "", words) for t in texts]
            yield pd.DataFrame({
                "sig": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64), "fp": np.array([fingerprint(t or "") if fingerprints else 0 for t in texts], np.int64), "n": np.array([len(s) for s in sets], np.int32),
                "prefix": pd.Series([prefix(s, threshold, frequent, place) for s in sets], dtype=object),
            })

    return marks(text)


def frequent_shingles(df: DataFrame, text: Column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles of a part of the texts, at most FREQUENT, and the place of each, the rarest first.

    The counts are written; a histogram of them tells from which count on there are no more than that, so that no
    task sends a list of its own to the driver.
    """
    some = df.select(text.alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(PART)) == 0).select(F.explode(hashes_column(F.col("t"), words)).alias("h"))
    counts = written(some.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > 1), "counts")
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    have, least = 0, None
    for r in steps:
        have += r["n"]
        if have > FREQUENT:
            break
        least = r["c"]
    rows = sorted(((r["c"], r["h"]) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1])) if least else []
    found = np.array([h for _, h in rows], np.int64)
    order = np.argsort(found)
    return found[order], np.arange(len(rows), 0, -1)[order]


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _side(listed: DataFrame, s: str, *more: str) -> DataFrame:
    return listed.select("h", F.col("sig").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "i", "l", *more)])


def _possible(threshold: float) -> Column:
    """What a pair a, b must meet at its first shared shingle to reach the threshold, known before any set is read.

    Sizes n must fit. Sets that reach it share ``o = ceil(t / (1 + t) * (na + nb))``. All that they share is at or after the places i of
    the first, so ``min(na - ia, nb - ib)`` is no less than o. In the common order the prefix that ends first has all that both
    prefixes share, and at most ``ceil(t * n) - 1`` others come after it: so both have ``o - ceil(t * max(na, nb)) + 1`` listed shingles, l.
    """
    both = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    return sizes & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both) & (F.least("la", "lb") >= both - F.ceil(F.greatest("na", "nb") * threshold - 1e-9) + 1)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """The pairs a, b of classes whose Jaccard reaches the threshold. docs: _key, t."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    places = written(classes.select("sig", "at").join(ends.hint("merge"), "sig", "left_semi"), "places")
    n = places.count()
    # rows of one key have one text: they give one set
    texts = docs.join(hinted(places, n, broadcast_rows), F.col("_key") == F.col("at"))
    sets = written(texts.select("sig", hashes_column(F.col("t"), words).alias("s")).dropDuplicates(["sig"]), "sets")
    x, y = sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), sets.select(F.col("sig").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return met.filter(F.col("i") >= (F.col("n") - F.col("i")) * threshold - 1e-9).select("a", "b")


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """The links of SimHash as pairs a < b of classes: of each component of linked fingerprints the first class with every other. prints: sig, fp."""
    marks = written(prints.select("sig", "fp").distinct(), "marks")
    roots = components(fingerprint_links(marks.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = written(marks.join(roots.hint("merge"), "fp", "left").select("sig", F.coalesce("root", "fp").alias("root")).distinct(), "rooted")
    first = written(rooted.groupBy("root").agg(F.min("sig").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    return rooted.join(first.hint("merge"), "root").select("a", F.col("sig").alias("b")).filter("a <> b")


def grouped(docs: DataFrame, classes: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, longest: int = 64, broadcast_rows: int = 100_000, given: DataFrame | None = None) -> DataFrame:
    """node, root of the components of all pairs of classes at the threshold and of those given. classes: sig, n, at, prefix; given: a, b."""
    index = written(classes.select("sig", "n", F.posexplode("prefix").alias("i", "h")), "index")
    sizes = written(index.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    listed = index.join(sizes.hint("merge"), "h")
    listed = written(listed.withColumn("l", F.count("*").over(W.partitionBy("sig"))), "listed")
    short, long_ = listed.filter(F.col("m") <= longest), listed.filter(F.col("m") > longest)
    possible = _possible(threshold)
    near = _side(short, "a").join(_side(short, "b").hint("merge"), "h").filter("a < b").filter(possible).select("a", "b")
    centre = F.row_number().over(W.partitionBy("h").orderBy(F.desc("l"), "sig"))
    centres = written(_side(long_.withColumn("_r", centre).filter(F.col("_r") <= CENTRES), "a"), "centres")
    stars = _pairs(_side(long_, "b").join(centres.hint("merge"), "h").filter("a <> b").filter(possible))
    first = verified(near.unionByName(stars).distinct(), docs, classes, words, threshold, broadcast_rows)
    if given is not None:
        first = first.unionByName(given)
    roots = written(components(written(first, "first")), "roots")
    rooted = written(long_.join(roots.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted")
    groups = rooted.groupBy("h", "root").agg(F.count("*").alias("c"))
    main = written(groups.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("g")).filter("g > 1").drop("g"), "main")
    if main.isEmpty():
        return roots
    mixed = written(rooted.join(main.hint("merge"), "h"), "mixed")
    x, y = _side(mixed.filter("root <> main"), "a", "root", "main"), _side(mixed, "b", "root")
    # two classes outside the main group meet twice: the smaller on the left counts
    rest = x.join(y.hint("merge"), "h").filter((F.col("roota") != F.col("rootb")) & ((F.col("rootb") == F.col("maina")) | (F.col("a") < F.col("b")))).filter(possible)
    rest = _pairs(rest).distinct()
    more = written(verified(rest, docs, classes, words, threshold, broadcast_rows), "more")
    if more.isEmpty():
        return roots
    # each node and its root stand for the links that are done
    return components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).filter("a <> b")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, longest: int = 64, broadcast_rows: int = 100_000, fingerprints: bool = False) -> DataFrame:
    """id_col, _key (tells rows of one id apart), fp (long, the group) and component_id (the smallest id reachable) of each row.

    fingerprints: the links of op4_simhash are links too.
    """
    small_batches(df.sparkSession, size=BATCH_BYTES // 4)  # sets of shingles take several times their texts
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), text.alias("t"))
    frequent, place = frequent_shingles(df, text, words)
    marked = docs.select("_id", "_key", _marks(F.col("t"), words, threshold, frequent, place, fingerprints).alias("m")).select("_id", "_key", "m.*")
    prints = written(marked, "prints")
    classes = written(prints.groupBy("sig").agg(F.min("_id").alias("least"), F.min("_key").alias("at"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")
    given = written(by_fingerprint(prints), "given") if fingerprints else None
    roots = grouped(docs.select("_key", "t"), classes, words, threshold, longest, broadcast_rows, given).withColumnRenamed("node", "sig")
    rooted = written(classes.select("sig", "least").join(roots.hint("merge"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(groups.hint("merge"), "root").select("sig", "root", "component_id"), "named")
    return prints.select("_id", "_key", "sig").join(named.hint("merge"), "sig").select(F.col("_id").alias(id_col), "_key", F.col("root").alias("fp"), "component_id")
