"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join; the links of a step are written to the shared folder, so
lineage stays short and a lost executor costs one step. The minima are written too: both sides of the
join are then dealt out for it alone, and Spark can split a node with very many links. Nothing is
collected but a count and a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it knows."""
    near = _both(links)
    least = written(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return near.filter("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b")
    own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link; links: columns a and b of one orderable type.

    The root is the smallest node of the component. Self links, repeated links and links given in
    both directions change nothing; no links give an empty table; links with a null end are ignored.
    """
    now = links.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, before = written(now, "links"), None
    state = _state(now)
    while state[0] and state != before:
        before = state
        now = written(_small_star(_large_star(now)), "links")
        state = _state(now)
    pairs = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
