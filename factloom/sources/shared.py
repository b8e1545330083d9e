"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_folder(spark)}/factloom/{tag}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, with a real size, and safe from lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side only where its counted rows are within a fixed limit; else a sort-merge join."""
    return df.hint("broadcast") if rows <= limit else df.hint("merge")
