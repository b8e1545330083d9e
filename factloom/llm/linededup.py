r"""Line dedup by overlapping windows of three consecutive lines.

Each document's lines are hashed, and each run of three consecutive lines is one window with a
128-bit hash. Windows that occur more than once anywhere are found by one aggregation; all but the
first occurrence (by doc_id, then position) are later occurrences, and the lines that they cover,
merged over overlapping windows, are removed.

Defined cases: texts of any length are read whole;
lines end at "\n", and spaces (not tabs or carriage returns) at a line's end don't count;
windows of blank lines alone are ignored; null texts count as empty; documents of fewer than three lines
stay as they are; rows with the same doc_id and text are one occurrence and stay alike; of rows with one
doc_id, or with none, and different texts the one with the smaller hash comes first at each position; a
null doc_id comes first; where a window overlaps its own first occurrence, only the lines before it stay;
a text whose lines are all removed becomes empty and its row stays; other columns, of any name, pass
through, except that columns n_lines and n_removed are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_key, hinted, keyed, quoted, row_key, table, text_of, written

WIDTH = 3


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """_id, _key, _pos, _h1, _h2 of every window of every row."""
    lines = F.split(text_of(text_col), "\n")
    hashed = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.transform(lines, lambda x: F.xxhash64(F.rtrim(x))).alias("_lines"))
    placed = hashed.filter(F.size("_lines") >= width).select("_id", "_key", "_lines", F.explode(F.sequence(F.lit(0), F.size("_lines") - width)).alias("_pos"))
    parts = [F.get("_lines", F.col("_pos") + i) for i in range(width)]
    blank = F.xxhash64(F.lit(""))
    some = parts[0] != blank
    for p in parts[1:]:
        some = some | (p != blank)
    return placed.filter(some).select("_id", "_key", "_pos", F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(1), *parts[::-1]).alias("_h2"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """_pid, _pkey and gone, the sorted positions of the lines to remove, of each row that has some."""
    all_ = written(windows(docs, id_col, text_col, width), "windows")
    place = F.struct("_id", "_pos", "_key")
    repeated = written(all_.groupBy("_h1", "_h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("_h1", "_h2", "first"), "repeated")
    later = all_.join(repeated.hint("merge"), ["_h1", "_h2"]).filter(~place.eqNullSafe(F.col("first"))).select("_id", "_key", "_pos").distinct()
    starts = later.groupBy("_id", "_key").agg(F.collect_list("_pos").alias("starts"))  # at most one a line of a text
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1))))))
    return written(starts.select(F.col("_id").alias("_pid"), F.col("_key").alias("_pkey"), covered.alias("gone")), "covered")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, broadcast_lines: int = 1_000_000) -> DataFrame:
    """docs without later occurrences of repeated windows, with n_lines and n_removed (long) added.

    broadcast_lines: up to so many rows and removed lines together, which are counted, their positions are broadcast,
    so that texts aren't shuffled; beyond that the rows meet in a merge join.
    """
    gone = covered_lines(docs, id_col, text_col, width)
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 8), F.lit(0))).first()[0]
    both = keyed(docs, id_col, text_col).join(hinted(gone, size, broadcast_lines), at_key(), "left")
    lines = F.split("_text", "\n")
    # the places that stay, by one hash set a text, then the lines at those places
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    both = both.withColumn("n", F.size(lines).cast("long")).withColumn("kept", F.when(F.col("gone").isNotNull(), _lines_at(lines, stay)))
    out = [F.when(F.col("gone").isNull(), F.col(quoted(c, "_row"))).otherwise(F.col("kept")).alias(c) if c == text_col else F.col(quoted(c, "_row")) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(*out, F.col("n").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def _lines_at(lines: Column, places: Column) -> Column:
    """The lines at some places, joined; both arrays are made once a row, not once an element."""
    return F.get(F.transform(F.array(F.struct(lines.alias("l"), places.alias("p"))), lambda x: F.array_join(F.transform(x["p"], lambda i: F.get(x["l"], i)), "\n")), F.lit(0))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("text_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, rtrim(ls[pos], ' ') AS a, rtrim(ls[pos + 1], ' ') AS b, rtrim(ls[pos + 2], ' ') AS c FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE a <> '' OR b <> '' OR c <> ''),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS text
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM k"""
}
