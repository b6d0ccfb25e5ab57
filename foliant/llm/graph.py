"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import joined_by_size, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> one row a node: node, component (its smallest reachable node).

    Each round hangs every node's neighbours on its smallest one, first the larger, then the smaller
    neighbours, until nothing moves. A hub's edges stay where they are (see ``joined_by_size``). No edges give no rows; loops and repeated edges change nothing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        total = seen[0]
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = joined_by_size(up, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_by_size(large, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        now = written(small, "edges")
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def mark(edges: DataFrame) -> tuple:
    """Size and an order-free sum of the edges: two rounds with equal marks are equal."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.shiftright(h, 7).cast("decimal(38,0)"))).first())
