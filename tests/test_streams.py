"""Streams against their batch twins, over one file and over several that come one by one."""

import pytest
from pyspark.sql import functions as F

from factloom.sources import views as V
from factloom.streaming import logs
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Events in five files in the order of their times, one a batch."""
    folder = str(tmp_path_factory.mktemp("events"))
    for i in range(5):
        rows = spark.read.parquet(f"{SMALL}/events.parquet")
        low, high = rows.select(F.percentile("event_id", i / 5), F.percentile("event_id", (i + 1) / 5)).first()
        rows.filter((F.col("event_id") >= low) & ((F.col("event_id") < high) | F.lit(i == 4))).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_closed_hours_equal_the_batch(spark):
    every, last = rows(logs.usage_windows(V.table(spark, SMALL, "events"))), spark.read.parquet(f"{SMALL}/events.parquet").select(F.unix_seconds(F.max("ts").cast("timestamp"))).first()[0]
    assert rows(logs.q_stream_usage(spark, SMALL)) == {r for r in every if r[0] + 3600 <= last - 600}


def test_closed_sessions_are_of_the_batch(spark):
    every, out = rows(logs.sessions(V.table(spark, SMALL, "events"))), rows(logs.q_stream_sessions(spark, SMALL))
    last = max(r[0] for r in every)
    assert out <= every and {r for r in every if r[0] < last - 86400} <= out


def test_dedupe_forgets(spark, parts):
    """Within the time a key is remembered nothing is doubled; over several batches all keys are there."""
    every = rows(V.table(spark, SMALL, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long")).distinct())
    assert rows(logs.run(logs.deduplicated(parts), "dedupe")) == every and rows(logs.q_stream_dedupe(spark, SMALL)) == every


def test_ingest_keeps_one_of_each(spark, parts):
    every = spark.read.parquet(f"{SMALL}/events.parquet").select(F.countDistinct("event_id")).first()[0]
    for out in (logs.q_stream_ingest(spark, SMALL), logs.ingest(spark, parts.select("event_id", "user_id").union(parts.select("event_id", "user_id")), "event_id", "twice")):
        assert out.count() == out.select("event_id").distinct().count() == every
