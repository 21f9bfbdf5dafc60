"""Density clustering and topic hierarchy as iterative DataFrame jobs.

Density clustering (re-aimed): points in a low-dimensional projection are
binned into a grid of cells of width ``width``; a cell whose neighbourhood
(touching cells included) holds at least ``min_points`` points is a core
cell; touching core cells form one cluster (connected components); border
cells attach to a touching core cell; the rest and clusters smaller than
``min_cluster_size`` are noise (−1).  Work is linear: per point one cell,
per occupied cell 3^d neighbour keys and equi-joins — no pairwise distances
between points.

Connected components are found with star steps (``components``), without a cap
on rounds.

Topic hierarchy: single linkage over topic centroids = the minimum spanning
tree of the pairwise distances in Kruskal order, built with Borůvka rounds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import dense_order_ids
from .components import connected_components


def _offsets(d: int) -> Column:
    offs = [list(o) for o in itertools.product((-1, 0, 1), repeat=d)]
    return F.array(*[F.array(*[F.lit(x) for x in o]) for o in offs])


def grid_density_clusters(points: DataFrame, coords: str = "coords", id_col: str = "id",
                          width: float | Column = 0.5, min_points: int = 3,
                          min_cluster_size: int = 3) -> DataFrame:
    """``(id, cluster)``; cluster ids are component ids, −1 = noise.

    A cell is a core cell when its neighbourhood (itself and the 3^d − 1
    touching cells) holds ≥ ``min_points`` points; touching core cells are
    connected; a non-core cell touching a core cell joins the smallest such
    cluster (border points); everything else is noise.
    """
    d = len(points.select(coords).first()[0])
    w = width if isinstance(width, Column) else F.lit(float(width))
    # the width may be a scalar subquery: bind it to a column before the lambda
    cell = F.transform(coords, lambda x: F.floor(x / F.col("_w")).cast("int"))
    pts = (points.withColumn("_w", w).select(id_col, cell.alias("cell"))
                 .withColumn("key", F.array_join("cell", ",")))
    cells = pts.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))

    def around(df):
        return F.explode(F.transform(_offsets(d), lambda o: F.array_join(
            F.zip_with(df["cell"], o, lambda a, b: a + b), ",")))

    spread = (cells.select(around(cells).alias("key"), "n")
                   .groupBy("key").agg(F.sum("n").alias("nbhd")))
    occupied = cut_lineage(cells.join(spread, "key").withColumn("cid", F.xxhash64("key"))
                                .withColumn("core", F.col("nbhd") >= min_points))
    core = occupied.where("core")
    nbr = core.select(F.col("cid").alias("src"), around(core).alias("key"))
    edges = nbr.join(core.select("key", F.col("cid").alias("dst")), "key").select("src", "dst")
    comp = connected_components(core.select(F.col("cid").alias("id")), edges)
    core_comp = core.select("key", "cid").join(comp.withColumnRenamed("id", "cid"), "cid")
    border = (occupied.where(~F.col("core")).select("key", "cell")
              .select("key", around(occupied.where(~F.col("core"))).alias("nkey"))
              .join(core_comp.select(F.col("key").alias("nkey"), "component"), "nkey")
              .groupBy("key").agg(F.min("component").alias("component")))
    cell_comp = core_comp.select("key", "component").unionByName(border)
    labelled = pts.join(cell_comp, "key", "left")
    sizes = (labelled.where(F.col("component").isNotNull()).groupBy("component")
                     .agg(F.count(F.lit(1)).alias("_size")))
    out = labelled.join(sizes, "component", "left")
    return out.select(id_col, F.when(F.col("_size") >= min_cluster_size, F.col("component"))
                      .otherwise(F.lit(None)).alias("cluster")).fillna({"cluster": -1})


def single_linkage(pairs: DataFrame, a: str = "topic_a", b: str = "topic_b",
                   dist: str = "distance") -> DataFrame:
    """Merge table ``step, left, right, distance`` = MST edges of the
    distance graph in ascending order (ties by endpoints), via Borůvka."""
    e = cut_lineage(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"),
                                 F.col(dist).alias("d")))
    nodes = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    comp = cut_lineage(nodes.select("id", F.col("id").alias("comp")))
    mst = None
    while True:
        ce = (e.join(comp.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u")
               .join(comp.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v")
               .where(F.col("cu") != F.col("cv")))
        if ce.limit(1).count() == 0:
            break
        edge = F.struct("d", "u", "v")
        best = (ce.select(F.col("cu").alias("c"), edge.alias("s"))
                  .union(ce.select(F.col("cv").alias("c"), edge.alias("s")))
                  .groupBy("c").agg(F.min("s").alias("s"))
                  .select("s.d", "s.u", "s.v").distinct())
        best = cut_lineage(best)
        mst = best if mst is None else cut_lineage(mst.union(best).distinct())
        # merge components joined by the chosen edges
        cedges = (best.join(comp.select(F.col("id").alias("u"), F.col("comp").alias("src")), "u")
                      .join(comp.select(F.col("id").alias("v"), F.col("comp").alias("dst")), "v")
                      .select("src", "dst"))
        cnodes = comp.select(F.col("comp").alias("id")).distinct()
        cc = connected_components(cnodes, cedges)
        comp = cut_lineage(comp.join(cc.select(F.col("id").alias("comp"), "component"), "comp")
                               .select("id", F.col("component").alias("comp")))
    if mst is None:
        return pairs.sparkSession.createDataFrame([], "step long, left long, right long, distance double")
    ranked = dense_order_ids(mst, ["d", "u", "v"], "step")
    return ranked.select("step", F.col("u").alias("left"), F.col("v").alias("right"),
                         F.col("d").alias("distance"))
