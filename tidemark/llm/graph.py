"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, stored


def _nearest(edges: DataFrame, at: str, other: str) -> DataFrame:
    """Smallest neighbour of each node; pre-aggregated before the shuffle, so hubs are no hot groups."""
    return edges.groupBy(F.col(at).alias("c")).agg(F.min(other).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    Each step is two joins on nodes; the number of steps grows with the logarithm of the component
    size.  The edge table is written to the shared folder after each step, and so are the smallest
    neighbours: a join of two plain tables is split where a hub has many edges.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = near = stored(_nearest(both, "u", "v").select("c", F.least("c", "m").alias("m")))
        large = both.join(near, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        near = stored(_nearest(large, "u", "v"))
        small = large.join(near, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stored(small)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for used in (now, first, large, near):
            forget(used)
        now = after
        if mark == seen:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
