"""Files in and out: an index of JSON lines, training splits as JSON lines, reviews as CSV.

Sinks write to a new folder and a query reads back what is there, so a round trip is what is tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import views as V
from factloom.sources.shared import fresh_path

#: The columns of a review file, in order.
REVIEW_FIELDS = (
    "example_id", "query_type", "difficulty", "question", "target", "source", "section", "parent_ids", "evidence", "automated_status", "benchmark_overlap", "issues", "warnings",
    "status", "reviewed_by", "reviewed_at", "reviewer_notes",
)
_RECORD = "child_id string, text string, metadata map<string,string>, _bad string"
#: Texts with line ends, quotes and spaces at their ends come back as they were.
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\\N", "encoding": "UTF-8"}


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """child_id, text, metadata, reason of each line of an index that isn't blank; reason: invalid JSON, missing fields, or null for a good record."""
    lines = spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    r = lines.select(F.from_json("value", _RECORD, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    reason = F.when(F.col("_bad").isNotNull(), "invalid JSON").when(F.col("child_id").isNull() | F.col("text").isNull() | F.col("metadata").isNull(), "missing fields")
    return r.select("child_id", "text", "metadata", reason.alias("reason"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """child_id, text, metadata of an index; bad lines and an index without records are errors."""
    rows = scan_jsonl(spark, path)
    n, bad = rows.agg(F.count("*"), F.count("reason")).first()
    if bad or not n:
        raise ValueError(f"{bad} bad lines" if bad else "the index is empty")
    return rows.drop("reason")


def write_splits(rows: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Rows with a split as JSON lines, a folder each; gives split, n and digest (the sum of the digests of its lines, in any order)."""
    lines = rows.filter(F.col(split).isNotNull()).select(F.col(split).alias("split"), F.to_json(F.struct(*[c for c in rows.columns if c != split])).alias("value"))
    lines.write.partitionBy("split").text(path)
    part = F.conv(F.substring(F.sha2("value", 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.sparkSession.read.schema("value string, split string").text(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


def read_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema("value string, split string").text(path).select(F.from_json("value", schema).alias("r"), "split").select("r.*", "split")


def write_reviews(examples: DataFrame, path: str) -> None:
    """The review columns as CSV; those that examples lack are empty; arrays are joined."""
    kinds = dict(examples.dtypes)
    text = lambda c: F.lit(None).cast("string") if c not in kinds else F.array_join(c, " | ") if kinds[c].startswith("array") else F.col(c).cast("string")
    examples.select(*[text(c).alias(c) for c in REVIEW_FIELDS]).write.options(**_CSV).csv(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in REVIEW_FIELDS)).options(**_CSV).csv(path)


# -- queries ----------------------------------------------------------------------------------------


def q_lexical_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as JSON lines, of which some are cut off, some lack their text and some are blank."""
    path, i = fresh_path(spark, "index"), F.col("doc_id")
    c = V.chunks(spark, sf_dir)
    line = F.to_json(F.struct("child_id", F.when(i % 13 != 1, F.col("text")).alias("text"), F.create_map(F.lit("ticker"), F.coalesce("ticker", F.lit(""))).alias("metadata")))
    c.select(_broken(line, i).alias("value")).write.text(path)
    r = scan_jsonl(spark, path)
    return r.select("child_id", F.sha2("text", 256).alias("text_sha256"), F.element_at("metadata", "ticker").alias("ticker"), "reason")


def _broken(line, i):
    return F.when(i % 17 == 2, F.lit("  ")).when(i % 11 == 3, F.concat(F.lit("{"), line)).otherwise(line)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("example_id")
    split = F.when(i % 10 < 7, "train").when(i % 10 == 7, "validation").when(i % 10 == 8, "test")
    return V.examples(spark, sf_dir).select("example_id", "group_id", "question", "query_type", split.alias("split"))


def q_sink_jsonl_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "splits")
    write_splits(_assigned(spark, sf_dir), path)
    return read_splits(spark, path, "example_id long, group_id string, question string, query_type string").select("split", "example_id", "group_id", "query_type", F.sha2("question", 256).alias("question_sha256"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir)
    return e.select("example_id", "query_type", "question", F.array("group_id", "query_type").alias("source"), "benchmark_overlap", F.col("review_status").alias("status"), F.when(F.col("example_id") % 3 == 0, ' "ann", \n').alias("reviewer_notes"))


def q_review_csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header and the rows of the file, counted by their columns."""
    path = fresh_path(spark, "reviews")
    write_reviews(_reviews(spark, sf_dir), path)
    rows = read_reviews(spark, path)
    return rows.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in REVIEW_FIELDS])


def q_review_csv_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "reviews")
    write_reviews(_reviews(spark, sf_dir), path)
    return read_reviews(spark, path).select(F.col("example_id").cast("long").alias("example_id"), "query_type", F.sha2("question", 256).alias("question_sha256"), "source", "benchmark_overlap", "status", F.sha2("reviewer_notes", 256).alias("notes_sha256"))


QUERIES = {"lexical_jsonl_scan": q_lexical_jsonl_scan, "sink_jsonl_splits": q_sink_jsonl_splits, "review_csv_out": q_review_csv_out, "review_csv_in": q_review_csv_in}
_FILLED = {"example_id", "query_type", "question", "source", "benchmark_overlap", "status"}
ORACLES = {
    "lexical_jsonl_scan": V.with_views("chunks") + " SELECT CASE WHEN doc_id % 11 <> 3 THEN child_id END AS child_id, CASE WHEN doc_id % 11 <> 3 AND doc_id % 13 <> 1 THEN sha256(text) END AS text_sha256, CASE WHEN doc_id % 11 <> 3 THEN coalesce(ticker, '') END AS ticker, CASE WHEN doc_id % 11 = 3 THEN 'invalid JSON' WHEN doc_id % 13 = 1 THEN 'missing fields' END AS reason FROM chunks WHERE doc_id % 17 <> 2",
    "sink_jsonl_splits": V.with_views("examples") + " SELECT CASE WHEN example_id % 10 < 7 THEN 'train' WHEN example_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split, example_id, group_id, query_type, sha256(question) AS question_sha256 FROM examples WHERE example_id % 10 < 9",
    "review_csv_out": V.with_views("examples") + " SELECT count(*) AS rows, " + ", ".join(f"count({dict(source='group_id', status='review_status').get(c, c)}) AS {c}" if c in _FILLED else f"count(CASE WHEN example_id % 3 = 0 THEN 1 END) AS {c}" if c == "reviewer_notes" else f"0::BIGINT AS {c}" for c in REVIEW_FIELDS) + " FROM examples",
    "review_csv_in": V.with_views("examples") + " SELECT example_id, query_type, sha256(question) AS question_sha256, group_id || ' | ' || query_type AS source, benchmark_overlap::VARCHAR AS benchmark_overlap, review_status AS status, CASE WHEN example_id % 3 = 0 THEN sha256(' \"ann\", ' || chr(10)) END AS notes_sha256 FROM examples",
}
