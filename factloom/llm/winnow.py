r"""Document fingerprints by winnowing.

A text becomes lower-case words of letters, marks and digits, and each word one 64-bit hash. The hash of
a run of ``k`` words is a cyclic polynomial, a rolling hash: the words' hashes, each rotated by one bit
more than the next, added without carry; no string is hashed again for a run. In each window of ``w``
consecutive runs the smallest hash is chosen, the rightmost of equal ones. The chosen hashes and their
positions are the fingerprint: two texts that share a run of at least ``w + k - 1`` words share a chosen
hash, and no run shorter than ``k`` words ever matches. Words, not characters, are the units: an array of
single characters would cost native Spark an object each.

Hashes have 39 bits and share a long with the position (24 bits, counted down), so that the minimum of
a window is one comparison and its rightmost tie wins. A window minimum is built by doubling: of
spans of 1, 2, 4, ... hashes.

Defined cases: null and empty texts, and texts without words, have an empty fingerprint; a text of
fewer than ``k`` words has one hash, of all its words; of fewer than ``w`` hashes the smallest is
chosen; the likeness of two empty fingerprints is 1, of an empty and another 0; positions are exact for up
to 2^24 words, more than a text of Spark's usual sizes holds, and stay at the last beyond; repeated rows
have equal fingerprints; ids may be of any orderable type, null ones come first, and equal ids follow each
other by text; with_fingerprint() passes columns of any name through, except that its output column is
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hinted, quoted, table, text_of, written

K, WINDOW = 3, 8
_POSITIONS = (1 << 24) - 1
#: Rows and characters of a bucket of neighbouring ids on the mean, and buckets whose heads are broadcast; they set sizes of tasks, not results.
BUCKET_ROWS, BUCKET_CHARS, BUCKETS = 1000, 8_000_000, 100_000
#: Characters of a partition of buckets, about.
PARTITION_CHARS = 64_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _turned(h: Column, n: int) -> Column:
    """h rotated left by n bits."""
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def _packed(h: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 25), 24).bitwiseOR(F.lit(_POSITIONS).cast("long") - F.least(i, F.lit(_POSITIONS)).cast("long"))


def _grams(hashes: Column, k: int) -> Column:
    """Packed hash and position of each run of k words, of the words' hashes."""

    def rolled(n: int, i: Column) -> Column:
        out = _turned(F.get(hashes, i), n - 1)
        for j in range(1, n):
            out = out.bitwiseXOR(_turned(F.get(hashes, i + j), n - 1 - j))
        return out

    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: _packed(rolled(k, i), i))
    out = F.when(F.size(hashes) >= k, runs)
    for n in range(k - 1, 0, -1):
        out = out.when(F.size(hashes) == n, F.array(_packed(rolled(n, F.lit(0)), F.lit(0))))
    return out.otherwise(F.array().cast("array<long>"))


def _least_of(hashes: Column, span: int) -> Column:
    """least of each hash and the one span places on; as many as there are such pairs."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1 - span), lambda i: F.least(F.get(hashes, i), F.get(hashes, i + span)))


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", k: int = K, window: int = WINDOW) -> DataFrame:
    """df with out_col, array<long>: the chosen grams in order, each a hash and a position (see ``hash_of`` and ``position_of``).

    window: a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    # helpers with names that no table has: packing the row into a struct would hide how it is dealt out, and shuffle it again
    own = f"_{uuid.uuid4().hex}_"
    kept = [F.col(quoted(c)) for c in df.columns if c != out_col]
    out = df.select(*kept, F.transform(words_of(text_of(text_col)), lambda w: F.xxhash64(w)).alias(f"{own}h"))
    out = out.select(*kept, _grams(F.col(f"{own}h"), k).alias(f"{own}1"))
    span = 1
    while span < window:
        out = out.withColumn(f"{own}{2 * span}", F.when(F.size(f"{own}{span}") > span, _least_of(F.col(f"{own}{span}"), span)).otherwise(F.col(f"{own}1")))
        span *= 2
    # fewer than ``window`` hashes: one window
    first = F.col(f"{own}1")
    chosen = F.when(F.size(first) >= window, F.array_distinct(f"{own}{window}")).when(F.size(first) > 0, F.array(F.array_min(first))).otherwise(first)
    return out.select(*kept, chosen.alias(out_col))


def hash_of(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 24)


def position_of(gram: Column) -> Column:
    return (F.lit(_POSITIONS).cast("long") - gram.bitwiseAND(F.lit(_POSITIONS).cast("long"))).cast("int")


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def as_text(fingerprint: Column) -> Column:
    """position:hash of each chosen gram, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda g: F.concat_ws(":", position_of(g).cast("string"), F.lower(F.hex(hash_of(g))))), ",")


def _in_line(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, object]:
    """(_id, _text, _bucket, _late; the window in which the next row of a row with _late = 0 follows it).

    Rows meet in buckets of neighbouring ids, in one shuffle to as many partitions as the texts need; the
    first row of a bucket is also sent to the bucket before it, as _late = 1. Whole numbers that are
    spread evenly have even buckets; other ids those of a range partitioning.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    low, high, n, chars = base.agg(F.min("_id"), F.max("_id"), F.count("*"), F.coalesce(F.sum(F.length("_text").cast("long")), F.lit(0))).first()
    line = W.partitionBy("_bucket").orderBy("_late", "_id", "_text")
    if n == 0:
        return base.withColumns({"_bucket": F.lit(0).cast("long"), "_late": F.lit(0)}), line
    buckets = max(1, n // BUCKET_ROWS, chars // BUCKET_CHARS)
    sizes = None
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        width = 1 if low is None else max(1, -(-(int(high) - int(low) + 1) // buckets))
        even = F.coalesce(F.expr(f"(_id - {low or 0}L) div {width}L"), F.lit(-1).cast("long")).alias("_bucket")
        sizes = base.select(even, "_id").groupBy("_bucket").agg(F.min("_id").alias("_head"), F.count("*").alias("rows"))
        sizes = sizes if sizes.agg(F.max("rows")).first()[0] <= 20 * max(BUCKET_ROWS, -(-n // buckets)) else None
    if sizes is not None:
        placed = base.withColumn("_bucket", even)
    else:  # ids in clumps, or not numbers
        ids = base.select("_id").distinct()
        ranged = written(ids.repartitionByRange(buckets, "_id").select("_id", F.spark_partition_id().cast("long").alias("_bucket")), "ranges")
        sizes = ranged.groupBy("_bucket").agg(F.min("_id").alias("_head"))
        other = ranged.withColumnRenamed("_id", "_rid")
        placed = base.join(other.hint("merge"), F.col("_id").eqNullSafe(F.col("_rid"))).drop("_rid")
    heads = written(sizes.select("_bucket", "_head"), "heads")
    # the bucket before each: runs of buckets in order, and of each run the last before it; both of at most the root of their number
    run = max(1, int(buckets**0.5))
    runs = heads.groupBy(F.expr(f"_bucket div {run}").alias("_run")).agg(F.max("_bucket").alias("_last"))
    ends = runs.select("_run", F.coalesce(F.lag("_last").over(W.orderBy("_run")), F.max("_last").over(W.partitionBy(F.lit(0)))).alias("_end"))
    own = heads.withColumn("_run", F.expr(f"_bucket div {run}")).withColumn("_prev", F.lag("_bucket").over(W.partitionBy("_run").orderBy("_bucket")))
    before = written(own.join(ends.hint("merge"), "_run").select(F.col("_bucket").alias("_own"), F.coalesce("_prev", "_end").alias("_before"), "_head"), "before")
    joined = placed.join(hinted(before, before.count(), BUCKETS), (F.col("_bucket") == F.col("_own")) & F.col("_id").eqNullSafe(F.col("_head")), "left")
    here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("late"))
    there = F.struct(F.col("_before").alias("b"), F.lit(1).alias("late"))
    spots = F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))
    spread = joined.select("_id", "_text", F.explode(spots).alias("_s")).select("_id", "_text", F.col("_s.b").alias("_bucket"), F.col("_s.late").alias("_late"))
    parts = min(buckets, chars // PARTITION_CHARS)
    return spread.repartition(parts, "_bucket") if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else spread, line


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, _text and _next: each row's text and the text of the next row by ascending id (after the last: the first).

    Equal ids follow each other by text; null ids come first.
    """
    spread, line = _in_line(docs, id_col, text_col)
    return spread.withColumn("_next", F.lead("_text").over(line)).filter("_late = 0").select(F.col("_id").alias(id_col), "_text", "_next")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against those of the text with its last half replaced by the next text's first, and of the next text."""
    spread, line = _in_line(docs, id_col, text_col)
    own = with_fingerprint(spread.withColumn("_next", F.lead("_text").over(line)), "_text", "_f").withColumn("_fh", hashes_of(F.col("_f")))
    both = own.withColumn("_nh", F.lead("_fh").over(line)).filter("_late = 0").withColumn("n_chars", F.length("_text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.expr("substring(_text, 1, cast(n_chars - n_chars div 2 as int))"), F.substring(F.col("_next"), F.lit(1), half))
    out = with_fingerprint(both.withColumn("_edited", edited), "_edited", "_e").withColumn("_eh", hashes_of(F.col("_e")))
    return out.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("_f")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_fh"), F.col("_eh")).alias("near_edited"), likeness(F.col("_fh"), F.col("_nh")).alias("near_next"),
    )


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_winnow": op10_winnow}
ORACLES: dict[str, str] = {}
