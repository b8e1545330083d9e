"""Overlapping parent and child windows of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import stable_id


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), 1)


def window_numbers(n: Column, size: Column, overlap: Column) -> Column:
    """0, 1, ... of the windows of size units, each overlapping the one before, that cover n units."""
    more = F.ceil((n - size) / (size - overlap)).cast("int")
    return F.sequence(F.lit(0), F.when(n <= size, F.lit(0)).otherwise(more))


def chunk_parent_child(df: DataFrame, id_col: str, text_col: str, meta: Sequence[str], kind_col: str, kinds: dict[str, tuple[int, int, int, int]], other: tuple[int, int, int, int]) -> DataFrame:
    """Children with ids, their parents and a prefix of the metadata; sizes (parent, overlap, child, overlap) by kind.

    Units are words. A text without words has no windows; null metadata is left out of the prefix.
    """

    def size(i: int) -> Column:
        out = F.lit(other[i])
        for kind, sizes in kinds.items():
            out = F.when(F.col(kind_col) == kind, F.lit(sizes[i])).otherwise(out)
        return out

    cut = df.select(id_col, *meta, word_list(F.col(text_col)).alias("_w"), *[size(i).alias(f"_s{i}") for i in range(4)]).filter(F.size("_w") > 0)
    parents = cut.withColumn("parent_index", F.explode(window_numbers(F.size("_w"), F.col("_s0"), F.col("_s1"))))
    start = F.col("parent_index") * (F.col("_s0") - F.col("_s1")) + 1
    parents = parents.select(id_col, *meta, "parent_index", "_s2", "_s3", F.slice("_w", start, F.col("_s0")).alias("_pw"), stable_id(F.lit("parent"), F.col(id_col), F.col("parent_index")).alias("parent_id"))
    children = parents.withColumn("child_index", F.explode(window_numbers(F.size("_pw"), F.col("_s2"), F.col("_s3"))))
    words = F.array_join(F.slice("_pw", F.col("child_index") * (F.col("_s2") - F.col("_s3")) + 1, F.col("_s2")), " ")
    prefix = F.concat(F.lit("["), F.concat_ws(" | ", *meta), F.lit("]\n"))
    return children.select(stable_id(F.lit("child"), F.col("parent_id"), F.col("child_index")).alias("child_id"), "parent_id", "parent_index", "child_index", id_col, *meta, F.concat(prefix, words).alias("text"))
