r"""SimHash fingerprints and near-duplicate groups.

A fingerprint has 64 bits over the hashes of 3-word shingles, repeats included. Groups join
fingerprints that differ in at most ``bits`` (0 to 2) bits, found by a byte-position inverted index with
count filtering: of the eight bytes of two such fingerprints at least ``8 - bits`` are equal in the same
position. The lists of the index are keyed by two of the four pairs of neighbouring bytes (two changed
bits leave two pairs equal), six lists a fingerprint; those with one fingerprint go. Pairs meet in these
lists; their shared positional bytes are tallied, pairs below ``8 - bits`` go, and the others are verified
by the number of differing bits. A list of over ``longest`` fingerprints, whose pairs would be too many to
tally, is first dealt out by two of its four remaining bytes: every pair that reaches the minimum of six
shared bytes still meets there, and at most 65,536 different fingerprints share six bytes. All links come
through the index, whatever the length of a list.

Defined cases: texts of any length are read whole;
null and empty texts have the fingerprint zero and link as any other; texts of one or
two words have one shingle, the whole sequence; repeated rows have equal results; a null doc_id
is kept, and counts as larger than any other id; columns of any name pass through keep_first(); an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_key, hinted, keyed, row_key, small_batches, table, text_of, written
from .components import components

WORDS = 3


def fingerprint(text: str, words: int = WORDS) -> int:
    """As a signed 64-bit number. bytes.lower() and bytes.split() touch ASCII alone, as asked for."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*[parts[i:] for i in range(words)], strict=False) if len(parts) >= words else [parts]
    return fingerprint_of(np.array([digest(join(g), 42) for g in grams], np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as a signed number; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        total += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or "", words) for t in texts], dtype=np.int64)

    return prints(text)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _keyed_by(fp: Column, choices: list[tuple[int, ...]]) -> Column:
    """array of (list, bytes): fp with only the bytes of each choice of places left."""
    masks = [sum(255 << (8 * i) for i in places) for places in choices]
    return F.array(*[F.struct(F.lit(n).cast("byte").alias("list"), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bytes")) for n, m in enumerate(masks)])


def shared_bytes(a: Column, b: Column) -> Column:
    return sum(((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8)), F.lit(0))


#: The lists of the first step, by four bytes, and of the second, by six: each adds two of the four that its first list leaves.
FIRST = [a + b for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
SECOND = {n: [(*places, *more) for more in combinations([i for i in range(8) if i not in places], 2)] for n, places in enumerate(FIRST)}


def tallied(listed: DataFrame, bits: int) -> DataFrame:
    """Pairs a < b that meet in a list, share at least ``8 - bits`` positional bytes and differ in at most ``bits`` bits."""
    x, y = listed.select("list", "bytes", F.col("fp").alias("a")), listed.select("list", "bytes", F.col("fp").alias("b"))
    enough = (F.col("a") < F.col("b")) & (shared_bytes(F.col("a"), F.col("b")) >= 8 - bits)
    return x.join(y.hint("merge"), ["list", "bytes"]).filter(enough).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def links(prints: DataFrame, bits: int = 2, longest: int = 64) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in at most ``bits`` bits, 0 to 2."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2: the lists of the index are those of at least six equal bytes")
    index = written(prints.select("fp", F.explode(_keyed_by(F.col("fp"), FIRST)).alias("k")).select("k.list", "k.bytes", "fp"), "index")
    sizes = written(index.groupBy("list", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    listed = written(index.join(sizes.hint("merge"), ["list", "bytes"]), "listed")
    keys = None
    for n, choices in SECOND.items():
        keys = F.when(F.col("list") == n, _keyed_by(F.col("fp"), choices)) if keys is None else keys.when(F.col("list") == n, _keyed_by(F.col("fp"), choices))
    deeper = listed.filter(F.col("n") > longest).select("list", F.explode(keys).alias("k"), "fp").select((F.col("list") * F.lit(6).cast("byte") + F.col("k.list")).cast("byte").alias("list"), "k.bytes", "fp")
    short = tallied(listed.filter(F.col("n") <= longest), bits)
    return short.unionByName(tallied(written(deeper, "deeper"), bits)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = 2) -> DataFrame:
    """id_col, _key (tells rows of one id apart), fp (long) and component_id (the smallest id reachable) of each row."""
    small_batches(df.sparkSession)
    prints = written(df.select(id_col, row_key(id_col, text_col).alias("_key"), fingerprint_column(text_of(text_col), words).alias("fp")), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(groups.hint("merge"), "root").select("fp", "component_id"), "named")
    return prints.join(named.hint("merge"), "fp").select(id_col, "_key", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000, groups=near_duplicates, **kinds) -> DataFrame:
    """The rows of df whose id is the smallest of their group, each id once, with df's columns.

    groups: gives the groups, with the columns of near_duplicates(). Of rows that share such an id the one with the smallest
    key stays, then the smallest by all columns; of a group of null ids alone, one.
    """
    found = groups(df, id_col, text_col, **kinds).select(F.col(id_col).alias("_pid"), F.col("_key").alias("_pkey"), "fp", F.col("component_id").eqNullSafe(F.col(id_col)).alias("leads"))
    found = written(found, "found")
    firsts = found.filter("leads").groupBy("_pid", F.when(F.col("_pid").isNull(), F.col("fp")).alias("g")).agg(F.min("_pkey").alias("best"), F.count("*").alias("n"))
    again = written(firsts.filter("n > 1").select("_pid", "g", "best"), "again")  # ids of several rows, one row each
    n_again = again.count()
    lost = found.filter("not leads").select("_pid", "_pkey")
    if n_again:
        met = found.filter("leads").select("_pid", "_pkey", F.when(F.col("_pid").isNull(), F.col("fp")).alias("h")).join(hinted(again.withColumnRenamed("_pid", "_rid"), n_again, broadcast_rows), F.col("_pid").eqNullSafe(F.col("_rid")) & F.col("h").eqNullSafe(F.col("g")))
        lost = lost.unionByName(met.filter("_pkey <> best").select("_pid", "_pkey"))
    lost = written(lost.distinct(), "lost")
    kept = keyed(df, id_col, text_col).join(hinted(lost, lost.count(), broadcast_rows), at_key(), "left_anti")
    if n_again:  # equal rows: of one key, which any row may have, the smallest
        twice = again.select(F.col("_pid"), F.col("best").alias("_pkey"), F.lit(True).alias("twice"))
        met = kept.join(hinted(twice, n_again, broadcast_rows), at_key(), "left").select("_id", "_key", "_row", "twice")
        one = met.filter("twice").groupBy("_id", "_key").agg(F.min("_row").alias("_row")).select("_row")
        return met.filter("twice is null").select("_row").unionByName(one).select("_row.*")
    return kept.select("_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
