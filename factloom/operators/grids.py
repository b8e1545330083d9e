"""HTML tables as grids: cells at their places, with column and row spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, CELL = r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)(<t[hd]\b[^>]*>.*?</t[hd]>)"
#: Fixed value: the most columns of one cell.
WIDEST = 1000


def _placed(rows, widths, heights) -> list[dict]:
    """The column and the width of each cell of a table, in order: the first free column of its row, up to a cell that reaches down from above."""
    until: dict[int, int] = {}  # the last row of the cell that was placed last in a column
    now, at, out = -1, 0, []
    for row, width, height in zip(rows, widths, heights, strict=True):
        if row != now:
            now, at = row, 0
        while until.get(at, -1) >= row:
            at += 1
        free = next((n for n in range(1, width) if until.get(at + n, -1) >= row), width)
        for column in range(at, at + free):
            until[column] = row + height - 1
        out.append({"col": at, "width": free})
        at += free
    return out


def placed(rows: Column, widths: Column, heights: Column) -> Column:
    @F.pandas_udf("array<struct<col:int,width:int>>")
    def of(rows: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([_placed(*x) for x in zip(rows, widths, heights, strict=True)], dtype=object)

    return of(rows, widths, heights)


def _span(cell: Column, name: str) -> Column:
    n = F.nullif(F.regexp_extract(cell, rf"(?is)^<t[hd][^>]*\b{name}=[\"']?(\d{{1,9}})", 1), F.lit("")).cast("int")
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))


def grid(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, cell (its place among the cells of its own row), first (the place is the cell's own), head, wide, value of each place of each table.

    A cell over n columns or rows fills them all; rows that a table lacks aren't made. tables: keys, html.
    """
    rows = F.regexp_extract_all("html", F.lit(ROW), 1)
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(F.regexp_extract_all(r, F.lit(CELL), 1), lambda c, k: F.struct(i.alias("row"), k.alias("cell"), c.alias("c")))))
    laid = tables.select(*keys, F.size(rows).alias("_n"), cells.alias("_cells"))
    wide, high = F.transform("_cells", lambda x: F.least(F.lit(WIDEST), _span(x["c"], "colspan"))), F.transform("_cells", lambda x: F.least(F.col("_n") - x["row"], _span(x["c"], "rowspan")))
    laid = laid.withColumns({"_w": wide, "_h": high}).withColumn("_p", placed(F.transform("_cells", lambda x: x["row"]), F.col("_w"), F.col("_h")))
    each = laid.select(*keys, F.explode(F.arrays_zip("_cells", "_p", "_w", "_h")).alias("x")).select(*keys, F.col("x._cells.row").alias("_r"), "x._cells.cell", "x._cells.c", "x._p.col", "x._p.width", F.col("x._w").alias("_w"), F.col("x._h").alias("_h"))
    value = F.trim(F.regexp_replace(F.regexp_replace("c", r"<[^>]+>", ""), r"\s+", " "))
    down = each.select(*keys, "_r", "cell", "col", "width", F.lower(F.substring("c", 2, 2)).eqNullSafe("th").alias("head"), (F.col("_w") > 1).alias("wide"), value.alias("value"), F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("_down"))
    out = down.select(*keys, (F.col("_r") + F.col("_down")).alias("row"), "col", "cell", "_down", "head", "wide", "value", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("_right"))
    return out.select(*keys, "row", (F.col("col") + F.col("_right")).alias("col"), "cell", ((F.col("_down") == 0) & (F.col("_right") == 0)).alias("first"), (F.col("_down") == 0).alias("own"), "head", "wide", "value")
