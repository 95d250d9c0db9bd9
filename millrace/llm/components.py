"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least neighbour or itself."""
    near = _both_ways(edges)
    near = near if large else near.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its least member) of every node of the links u, v (long); nodes alone do not occur.

    A hub's many links are dealt over tasks by partial aggregation and by the skew handling of Spark's joins.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(limit):
        edges = checkpoint(_star(_star(edges, large=True), large=False))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("v")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {limit} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
