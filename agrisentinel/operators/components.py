"""Connected components by alternating star steps, without a cap on rounds.

A large-star step hangs the larger neighbours of every node on the smallest node of
its neighbourhood, a small-star step its smaller neighbours and itself.  Long chains
shrink by a factor in each round.  The edge table of each round is written to the
shared scratch folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def _with_smallest(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the smallest neighbour of ``u``."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    large = (_with_smallest(both).where("v > u")
             .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
    near = _with_smallest(store(large, "stars-large"))
    small = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(near.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hung = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return not twice.limit(1).count() and not hung.limit(1).count()


def stars(links: DataFrame) -> DataFrame:
    """``id, component`` of the nodes that undirected ``links`` (src, dst) join to a smaller one."""
    edges = store(links.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                  .distinct(), "stars")
    while not _settled(edges):
        edges = store(_round(edges), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def connected_components(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """``node, component``: the smallest node reachable; a node without links is its own."""
    found = stars(links).withColumnRenamed("id", node)
    return nodes.select(node).join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))
