r"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct 5-word shingles, a power of two each. In a
partition an item's MinHash sketch is its ``k`` smallest shingle hashes; ``k`` follows from the
partition's largest size, so that a document that holds the threshold's share of an item's shingles
must hold some of the sketch: at most ``size - ceil(threshold * size)`` can miss. Every shingle of
every document is probed against the sketches of the partitions that it is long enough for (never one
sketch against the other, which would lose a short item in a long document), hits are tallied per
document and item, and pairs with enough of them are verified by exact containment of the shingles
themselves. Texts are read and cut twice: to probe, and, of candidates alone, to verify.

Defined cases: texts of any length are read whole;
texts are compared as lower-case runs of letters, marks and digits; an item of fewer
than five words is one shingle, the whole sequence; an item without words matches nothing, nor does
an empty or null text; repeated items and repeated rows give repeated pairs once; a null doc_id is
kept; drop_contaminated() passes columns of any name through, the others read the named ones alone; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_key, hinted, keyed, row_key, table, text_of, written

WORDS, THRESHOLD = 5, 0.8
#: Rows up to which the sketches, and the candidate pairs, are broadcast, and characters up to which the items' shingles are; counted before each join. They choose the kind of join, not rows.
SKETCH_ROWS, PAIR_ROWS, ITEM_CHARS = 200_000, 100_000, 16_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, width: Column) -> Column:
    """The distinct runs of width words, as strings."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) >= width, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, item_col: str, text_col: str, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(items with item_id, width, grams, size; sketch rows with item_id, width, h, need)."""
    parts = items.select(F.col(item_col).alias("item_id"), words_of(text_of(text_col)).alias("w")).filter(F.size("w") > 0)
    parts = parts.select("item_id", "w", F.least(F.size("w"), F.lit(words)).alias("width"))
    known = written(parts.select("item_id", "width", shingles(F.col("w"), F.col("width")).alias("grams")).distinct().withColumn("size", F.size("grams")), "items")
    lower = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double"))))  # the partition: sizes lower to 2 * lower - 1
    enough = lambda n: F.ceil(n * F.lit(threshold) - 1e-9)
    misses = lambda n: (n - enough(n)).cast("int")
    k = F.least(F.col("size"), misses(2 * lower - 1) + 1)
    hashed = known.select("item_id", "width", "size", enough(lower).cast("int").alias("least"), k.alias("k"), F.slice(F.array_sort(F.transform("grams", lambda g: F.xxhash64(F.split(g, " ")))), 1, k).alias("low"))
    return known, hashed.select("item_id", "width", "least", F.explode("low").alias("h"), (F.col("k") - misses(F.col("size").cast("double"))).alias("need"))


def candidates(docs: DataFrame, sketch: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key, item_id, width of the pairs whose tally of sketch hits reaches the guaranteed minimum."""
    sketch = written(sketch, "sketch")
    n, widths = sketch.count(), sorted(r[0] for r in sketch.select("width").distinct().collect())  # at most ``words`` widths
    split = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), words_of(text_of(text_col)).alias("_w"))
    least = widths[0] if widths else 1
    placed = split.filter(F.size("_w") >= least).select("_id", "_key", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - least)).alias("_i"))
    left = F.size("_w") - F.col("_i")
    runs = [F.when(left >= width, F.struct(F.lit(width).alias("width"), F.xxhash64(F.array(*[F.get("_w", F.col("_i") + j) for j in range(width)])).alias("h"))) for width in widths]
    # the words end here: an exploded row that kept them would copy the text
    rows = placed.select("_id", "_key", F.size("_w").alias("_n"), F.array(*runs).alias("rs") if runs else F.array().cast("array<struct<width:int,h:long>>").alias("rs"))
    rows = rows.select("_id", "_key", "_n", F.explode("rs").alias("r") if len(runs) != 1 else F.get("rs", F.lit(0)).alias("r")).filter("r is not null").select("_id", "_key", "_n", "r.width", "r.h")
    hits = rows.join(hinted(sketch, n, SKETCH_ROWS), ["width", "h"]).filter(F.col("_n") - F.col("width") + 1 >= F.col("least"))
    once = hits.groupBy("_id", "_key", "item_id", "width", "h").agg(F.min("need").alias("need"))
    return once.groupBy("_id", "_key", "item_id", "width").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter("n >= need").select("_id", "_key", "item_id", "width")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """_id, _key, item_id, shared, size, containment of the documents that hold enough of an item."""
    known, sketch = sketches(items, item_col, item_text, words, threshold)
    pairs = written(candidates(docs, sketch, id_col, text_col).withColumnsRenamed({"_id": "_pid", "_key": "_pkey"}), "pairs")
    places = written(pairs.select("_pid", "_pkey", F.col("width").alias("_width")).distinct(), "places")
    n, n_places = pairs.count(), places.count()
    chars = known.agg(F.coalesce(F.sum(F.length(F.array_join("grams", "  "))), F.lit(0))).first()[0]
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"))
    cut = base.join(hinted(places, n_places, PAIR_ROWS), at_key()).select("_id", "_key", "_width", words_of(F.col("_text")).alias("_w"))
    sets = cut.select("_id", "_key", "_width", shingles(F.col("_w"), F.col("_width")).alias("_grams"))
    met = sets.join(hinted(pairs, n, PAIR_ROWS), at_key() & (F.col("_width") == F.col("width"))).select("_id", "_key", "item_id", "_grams")
    each = met.join(hinted(known.select("item_id", "grams", "size"), chars, ITEM_CHARS), "item_id")
    exact = each.select("_id", "_key", "item_id", F.size(F.array_intersect("grams", "_grams")).cast("long").alias("shared"), F.col("size").cast("long").alias("size"))
    return exact.distinct().withColumn("containment", F.col("shared") / F.col("size")).filter(F.col("containment") >= threshold)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    bad = written(contained_items(docs, items, id_col, text_col, **kinds).select(F.col("_id").alias("_pid"), F.col("_key").alias("_pkey")).distinct(), "bad")
    return keyed(docs, id_col, text_col).join(hinted(bad, bad.count(), PAIR_ROWS), at_key(), "left_anti").select("_row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), "item_id", "shared", "size", "containment")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {
    "op5_decontaminate": r"""
WITH i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 5) AS width FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, width, array_to_string(w[p : p + width - 1], ' ') AS g FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM k)),
s AS (SELECT item_id, count(*) AS size FROM ig GROUP BY item_id),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
dp AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM k) WHERE len(w) >= width),
dg AS (SELECT DISTINCT doc_id, width, array_to_string(w[p : p + width - 1], ' ') AS g FROM dp)
SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size, count(*) / any_value(size) AS containment
FROM dg JOIN ig USING (width, g) JOIN s USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(size) >= 0.8"""
}
