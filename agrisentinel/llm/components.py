"""Connected components by alternating large-star and small-star steps.

A large-star step links every larger neighbour of a node to the smallest node of
its neighbourhood, a small-star step its smaller neighbours and itself.  Distances
shrink by a factor in each round, so a chain of n nodes takes about log(n) rounds;
there is no cap on rounds.  The steps keep the components; they end when every
node hangs on one root, which is then the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import broadcast_if_small, materialise, release


def _smallest(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest ``v`` of each ``u``."""
    return broadcast_if_small(materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "stars-smallest"), 32)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_smallest(both), "u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), "u")
    return (joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .union(joined.select("u", F.col("m").alias("v"))).distinct())


def _is_star(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, and none of those has one itself."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        return False
    roots = edges.select(F.col("v").alias("u")).distinct()
    return not edges.join(roots, "u", "left_semi").limit(1).count()


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of ``nodes`` (id) under undirected ``links`` (src, dst)."""
    edges = (links.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    edges = materialise(edges, "stars")
    while not _is_star(edges):
        large = materialise(_large_star(edges), "stars-large")
        release(edges)
        edges = materialise(_small_star(large), "stars")
        release(large)
    return (nodes.join(edges.select(F.col("u").alias("id"), "v"), "id", "left")
                 .select("id", F.coalesce("v", "id").alias("component")))
