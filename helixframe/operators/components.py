"""Connected components of a graph, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) grouped at u: every v, and u itself, to the least of u and all v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u"), F.col("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of an undirected graph to (node, root), root the least node that is reachable. Loops make nodes.

    Each round links every larger neighbour of a node to the node's least one, then every node's lesser neighbours to
    the least of them, until nothing changes: logarithmically many rounds, cut by checkpoints. Minima are combined
    map-side, and adaptive execution splits the join at a node with many neighbours.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        now = cut(small.where("a <> b").distinct())
    return nodes.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
