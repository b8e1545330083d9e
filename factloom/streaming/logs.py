"""Streams of request logs, each with the batch query that must give the same rows.

A stream reads Parquet files of events; ``run`` drives it over all that is there (availableNow) into a
Parquet table with a checkpoint in the cluster's shared folder, and reads it back. Hours and sessions are
appended once the watermark has passed their end; those that are still open at the end aren't there yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from factloom.sources import views as V
from factloom.sources.shared import fresh_path

#: How long rows may be late, how long a key is remembered, and keys of one folder of ingested rows.
LATE, REMEMBERED, KEYS = "10 minutes", "1 day", 1_000_000


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, with ts as a timestamp (watermarks need one with a zone)."""
    schema, reader = V.table(spark, sf_dir, "events").schema, spark.readStream
    folder = _is_folder(spark, f"{sf_dir}/events.parquet")
    rows = reader.schema(schema).parquet(f"{sf_dir}/events.parquet") if folder else reader.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def run(stream: DataFrame, tag: str) -> DataFrame:
    """Append all that is there to a table, and read it."""
    spark = stream.sparkSession
    base = fresh_path(spark, f"stream-{tag}")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def usage_windows(events: DataFrame) -> DataFrame:
    """Requests and tokens in each hour and type. The watermark lets hours close; late rows beyond ten minutes go."""
    k = F.get_json_object("props", "$.k").cast("long")
    source = events.withWatermark("ts", LATE) if events.isStreaming else events
    return source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "event_type", "calls", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    source = events.withWatermark("ts", LATE) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("turns")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "user_id", "turns")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row of each user, type and number. A stream forgets a key a day after its first row, by the time of the rows, so its state has a bound; a repeat that comes later than that is a new row."""
    keyed = events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    out = keyed.withWatermark("ts", REMEMBERED).dropDuplicatesWithinWatermark(["user_id", "event_type", "k"]) if events.isStreaming else keyed.dropDuplicates(["user_id", "event_type", "k"])
    return out.select("user_id", "event_type", "k")


def ingest(spark: SparkSession, stream: DataFrame, key: str, tag: str) -> DataFrame:
    """Rows whose key (a whole number) isn't there yet are appended batch by batch.

    Rows lie in folders by batch and by block of keys: a batch is compared with the earlier rows of its own blocks alone. A
    restarted batch writes its own folder again and never reads it, so nothing is doubled.
    """
    base = fresh_path(spark, f"stream-{tag}")
    block = F.floor(F.col(key) / KEYS).cast("long")
    schema = StructType([*stream.schema.fields]).add("batch", IntegerType()).add("block", LongType())

    def upsert(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("block", block)
        if number > 0:
            blocks = [r[0] for r in fresh.select("block").distinct().limit(1001).collect()]
            done = batch.sparkSession.read.schema(schema).parquet(f"{base}/out").filter(F.col("batch") < number)
            if len(blocks) <= 1000:  # a batch of more blocks reads all
                done = done.filter(F.col("block").isin(blocks))
            fresh = fresh.join(done.select(key).hint("merge"), key, "left_anti")
        fresh.write.mode("overwrite").partitionBy("block").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select(*stream.columns)


def q_stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(usage_windows(events_stream(spark, sf_dir)), "usage")


def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(sessions(events_stream(spark, sf_dir)), "sessions")


def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(deduplicated(events_stream(spark, sf_dir)), "dedupe")


def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events_stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    return ingest(spark, stream, "event_id", "ingest")


QUERIES = {"stream_usage": q_stream_usage, "stream_sessions": q_stream_sessions, "stream_dedupe": q_stream_dedupe, "stream_ingest": q_stream_ingest}
ORACLES = {
    "stream_usage": "SELECT * FROM (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL) WHERE start_s + 3600 <= (SELECT epoch(max(ts)) FROM events) - 600",
    "stream_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT floor(epoch(min(ts)))::BIGINT AS start_s, user_id, count(*) AS turns FROM g GROUP BY user_id, s HAVING epoch(max(ts)) + 1800 <= (SELECT epoch(max(ts)) FROM events) - 600",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "stream_ingest": "SELECT DISTINCT event_id, user_id, event_type FROM events",
}
