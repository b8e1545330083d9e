"""Shared helpers: tables, and intermediate results in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Bytes of texts that Python gets in one batch, and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1000


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


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives later joins real sizes
    instead of estimates. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str):
    """Tells rows that share an id but not a text apart."""
    return F.xxhash64(F.col(id_col), text_of(text_col))


def quoted(name: str, of: str = "") -> str:
    """A column's name, or that of a field of a struct, as col() takes it, whatever characters it has."""
    return of + "." * bool(of) + "`" + name.replace("`", "``") + "`"


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key, _text and _row, the whole row: df's own columns are inside _row, so that none can clash with a helper."""
    return df.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"))


def at_key(x: str = "_id", y: str = "_key", a: str = "_pid", b: str = "_pkey"):
    """The same row: ids may be null."""
    return F.col(x).eqNullSafe(F.col(a)) & (F.col(y) == F.col(b))


def hinted(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side only where its counted rows are within a fixed limit; else a sort-merge join."""
    return df.hint("broadcast") if rows <= limit else df.hint("merge")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Whole texts go to Python, so in batches bounded by bytes as well as by rows; smaller settings stay.

    These are settings of the session, since a query reads them only when it runs.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)
