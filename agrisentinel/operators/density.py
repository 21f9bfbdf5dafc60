"""Density clustering with noise by mutual reachability.

The hierarchy of connected components over ever longer edges of the neighbour graph,
condensed to groups of ``min_size`` rows or more, from which the most stable
clusters are chosen (excess of mass).

* Core distance: distance to the ``min_samples``-th neighbour.  An edge weighs the
  largest of its distance and its ends' core distances; its level is 1 / weight.
* Components merge bottom-up, all edges of one weight at once.  A component becomes a
  cluster when it reaches ``min_size``.  Where two clusters or more meet, they end
  and a new one begins; smaller components join the cluster that they meet.
* A cluster's stability is the sum over its rows of (level at which the row left or
  the cluster split - level at which the cluster itself joined another).  It is
  chosen if its stability is at least that of the best choice below it.  Everything
  a cluster's choice needs is known when it ends, so one upward pass decides it.
* The cluster that holds everything is never chosen; clusters that no edge joins
  have ended at level 0.  Rows outside chosen clusters are noise.

While the graph has more than ``LOCAL`` edges, the shortest eighth of them is
contracted at a time by a distributed step: its components are found with star
steps, states are summed per component, edges are relabelled and thinned to the
shortest of each pair.  Edges of such a step count as long as its longest one.  The
rest, ``LOCAL`` edges at most, is merged edge by edge in one task.  Below ``LOCAL``
edges nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .components import stars

LOCAL = 1 << 20
STEP = 0.125
SHORTEST = 1e-12  # weights below count as this, so that levels stay finite

STATE = ("comp long, size long, cluster string, depth int, acc double, kids double, n_kids int, top double")
CLUSTER = "cluster string, parent string, stability double, kids double, n_kids int, top double, size long"
MEMBER = "comp long, cluster string, level double"


def reachability_edges(graph: DataFrame, min_samples: int) -> DataFrame:
    """``u, v, w`` (u < v) from ``row, other, d, rank``."""
    core = graph.where(F.col("rank") == min_samples).select("row", F.col("d").alias("core"))
    ends = (graph.select("row", "other", "d").join(core, "row")
                 .join(core.select(F.col("row").alias("other"), F.col("core").alias("far")), "other"))
    w = F.greatest("d", "core", "far")
    return ends.groupBy(F.least("row", "other").alias("u"), F.greatest("row", "other").alias("v")).agg(F.min(w).alias("w"))


def level(w):
    return F.lit(1.0) / F.greatest(w, F.lit(SHORTEST))


# --- bounded part: edge by edge in one task ---------------------------------------------

@dataclass
class Component:
    size: int
    cluster: str | None = None
    depth: int = 0
    acc: float = 0.0
    kids: float = 0.0
    n_kids: int = 0
    top: float = 0.0
    loose: list[int] = field(default_factory=list)  # components that are in no cluster yet

    def stability(self, at: float) -> float:
        return self.acc - self.size * at

    def best(self, at: float) -> float:
        return max(self.stability(at), self.kids) if self.n_kids else self.stability(at)


class Merger:
    """The upward pass over components held in memory (a bounded number)."""

    def __init__(self, min_size: int):
        self.min_size = min_size
        self.at: dict[int, Component] = {}
        self.parent: dict[int, int] = {}
        self.ended: list[tuple] = []
        self.joined: list[tuple] = []

    def add(self, comp: int, state: Component) -> None:
        self.at[comp], self.parent[comp] = state, comp

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def run(self, edges: Iterator[tuple[float, list[tuple[int, int]]]]) -> None:
        """``edges`` by rising weight, those of one weight together."""
        for w, pairs in edges:
            before = {r for pair in pairs for r in map(self.find, pair)}
            for u, v in pairs:
                a, b = self.find(u), self.find(v)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            groups: dict[int, list[int]] = {}
            for r in before:
                groups.setdefault(self.find(r), []).append(r)
            for root, parts in groups.items():
                if len(parts) > 1:
                    self.merge(root, parts, 1.0 / max(w, SHORTEST))

    def merge(self, root: int, parts: list[int], at: float) -> None:
        states = [self.at.pop(p) for p in parts]
        whole = Component(sum(s.size for s in states))
        clusters = [s for s in states if s.cluster is not None]
        loose = [c for s in states for c in s.loose]
        if len(clusters) == 1:
            one = clusters[0]
            whole.cluster, whole.depth, whole.kids, whole.n_kids, whole.top = (
                one.cluster, one.depth, one.kids, one.n_kids, one.top)
            whole.acc = one.acc + (whole.size - one.size) * at
        elif whole.size >= self.min_size:
            whole.depth = 1 + max((s.depth for s in clusters), default=0)
            whole.cluster, whole.acc, whole.top = f"{root}:{whole.depth}", whole.size * at, at
            whole.n_kids = len(clusters)
            whole.kids = sum(s.best(at) for s in clusters)
            self.ended += [(s.cluster, whole.cluster, s.stability(at), s.kids, s.n_kids, s.top, s.size) for s in clusters]
        if whole.cluster is None:
            whole.loose = loose
        else:
            self.joined += [(c, whole.cluster, at) for c in loose]
        self.at[root] = whole

    def close(self) -> None:
        """Clusters that nothing joins end at level 0."""
        self.ended += [(s.cluster, None, s.acc, s.kids, s.n_kids, s.top, s.size) for s in self.at.values() if s.cluster]


def _finish(min_size: int):
    """One task over the last, bounded part: rows of states (w null) and edges (size null)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = Merger(min_size)
        states, edges = part[part["w"].isna()], part[part["w"].notna()].sort_values("w")
        for r in states.itertuples():
            known = isinstance(r.cluster, str)
            m.add(int(r.u), Component(int(r.size), r.cluster if known else None, int(r.depth), r.acc, r.kids, int(r.n_kids),
                                      r.top, [] if known else [int(r.u)]))
        pairs = zip(edges["w"], zip(edges["u"].astype(int), edges["v"].astype(int)))

        def by_weight():
            here, group = None, []
            for w, pair in pairs:
                if w != here and group:
                    yield here, group
                    group = []
                here = w
                group.append(pair)
            if group:
                yield here, group
        m.run(by_weight())
        m.close()
        rows = [(*e, None, None) for e in m.ended] + [(cluster, None, None, None, None, None, None, comp, at)
                                                      for comp, cluster, at in m.joined]
        names = ["cluster", "parent", "stability", "kids", "n_kids", "top", "size", "comp", "level"]
        return pd.DataFrame(rows, columns=names).astype({"n_kids": "Int32", "size": "Int64", "comp": "Int64", "stability": float,
                                                         "kids": float, "top": float, "level": float})
    return run


# --- distributed steps ------------------------------------------------------------------

def _contract(edges: DataFrame, state: DataFrame, loose: DataFrame, longest: float, min_size: int):
    """Merge everything that edges up to ``longest`` join."""
    at = F.lit(1.0 / max(longest, SHORTEST))
    found = stars(edges.where(F.col("w") <= longest).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    found = store(found.union(roots), "density-found")
    parts = state.join(found.withColumnRenamed("id", "comp"), "comp")
    stability = F.col("acc") - F.col("size") * at
    best = F.when(F.col("n_kids") > 0, F.greatest(stability, F.col("kids"))).otherwise(stability)
    known = F.col("cluster").isNotNull()
    groups = parts.groupBy("component").agg(
        F.sum("size").alias("size"), F.count("cluster").alias("n"), F.max("cluster").alias("cluster"),
        F.max(F.when(known, F.col("depth"))).alias("depth"), F.sum(F.when(known, F.col("acc"))).alias("acc"),
        F.sum(F.when(known, F.col("size"))).alias("held"), F.sum(F.when(known, F.col("kids"))).alias("kids"),
        F.sum(F.when(known, F.col("n_kids"))).alias("n_kids"), F.max(F.when(known, F.col("top"))).alias("top"),
        F.sum(F.when(known, best)).alias("best"))
    one, born = F.col("n") == 1, F.col("size") >= min_size
    depth = F.coalesce("depth", F.lit(0)) + F.when(one | ~born, 0).otherwise(1)
    zero = F.lit(0.0)
    groups = store(groups.select(
        F.col("component").alias("comp"), "size",
        F.when(one, F.col("cluster")).when(born, F.concat_ws(":", F.col("component").cast("string"), depth.cast("string")))
         .alias("cluster"), depth.cast("int").alias("depth"),
        F.when(one, F.col("acc") + (F.col("size") - F.col("held")) * at).when(born, F.col("size") * at).otherwise(zero).alias("acc"),
        F.when(one, F.col("kids")).otherwise(F.coalesce("best", zero)).alias("kids"),
        F.when(one, F.col("n_kids")).otherwise(F.col("n")).cast("int").alias("n_kids"),
        F.when(one, F.col("top")).when(born, at).otherwise(zero).alias("top"), (F.col("n") > 1).alias("met")), "density-groups")
    merged = groups.select(F.col("comp").alias("component"), F.col("cluster").alias("parent"), "met")
    ended = (parts.where(known).join(merged.where("met"), "component")
                  .select("cluster", "parent", stability.alias("stability"), "kids", "n_kids", "top", "size"))
    moved = loose.join(found.withColumnRenamed("id", "comp"), "comp", "left").withColumn("component", F.coalesce("component", "comp"))
    moved = store(moved.join(merged.select("component", "parent"), "component", "left"), "density-moved")
    joined = moved.where(F.col("parent").isNotNull()).select("row", F.col("parent").alias("cluster"), at.alias("level"))
    loose = moved.where(F.col("parent").isNull()).select("row", F.col("component").alias("comp"))
    state = store(state.join(found.select(F.col("id").alias("comp")), "comp", "left_anti")
                  .unionByName(groups.drop("met")), "density-state")
    rest = edges.where(F.col("w") > longest)
    for end in ("u", "v"):
        rest = (rest.join(found.select(F.col("id").alias(end), "component"), end, "left")
                    .withColumn(end, F.coalesce("component", end)).drop("component"))
    rest = (rest.where("u != v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
                .agg(F.min("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
    return store(rest, "density-edges"), state, loose, store(ended, "density-ended"), joined


def condense(nodes: DataFrame, edges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Clusters (``CLUSTER``) and rows (``row, cluster, level``) of ``nodes`` (row)
    under ``edges`` (u, v, w); the weights to which contracted edges were rounded up."""
    edges = store(edges.select("u", "v", F.col("w").cast("double").alias("w")), "density-edges")
    state = nodes.select(F.col("row").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"),
                         F.lit(0).alias("depth"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("kids"), F.lit(0).alias("n_kids"),
                         F.lit(0.0).alias("top"))
    loose = nodes.select("row", F.col("row").alias("comp"))
    ended, joined, rounded = [], [], []
    while edges.count() > LOCAL:
        longest = edges.agg(F.percentile_approx("w", STEP, 10_000)).first()[0]
        edges, state, loose, e, j = _contract(edges, state, loose, longest, min_size)
        rounded.append(longest)
        ended.append(e)
        joined.append(j)
    # states that no edge is left for end here: clusters at level 0, the rest as noise
    touched = edges.select(F.col("u").alias("comp")).union(edges.select("v")).distinct()
    alone = state.join(touched, "comp", "left_anti").where("cluster is not null").select(
        "cluster", F.lit(None).cast("string").alias("parent"), F.col("acc").alias("stability"), "kids", "n_kids", "top", "size")
    last = (state.join(touched, "comp", "left_semi").withColumnRenamed("comp", "u").withColumns(
                {"v": F.lit(None).cast("long"), "w": F.lit(None).cast("double")})
            .unionByName(edges, allowMissingColumns=True))
    done = store(last.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finish(min_size), CLUSTER + ", comp long, level double"), "density-last")
    ended += [alone, done.where(F.col("comp").isNull()).drop("comp", "level")]
    joined.append(loose.join(done.where(F.col("comp").isNotNull()).select("comp", "cluster", "level"), "comp")
                       .select("row", "cluster", "level"))
    union = lambda frames, name: store(frames[0] if len(frames) == 1 else _union(frames), name)
    return union(ended, "density-clusters"), union(joined, "density-rows"), rounded


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def choose(clusters: DataFrame) -> DataFrame:
    """``cluster, chosen``: the topmost cluster above (or equal) that is worth choosing."""
    roots = clusters.where(F.col("parent").isNull())
    single = roots.limit(2).count() == 1
    worth = (F.col("n_kids") == 0) | (F.col("stability") >= F.col("kids"))
    if single:
        worth &= F.col("parent").isNotNull()
    paths = store(clusters.select("cluster", F.col("parent").alias("up"), F.when(worth, F.col("cluster")).alias("chosen")),
                  "density-paths")
    while paths.where(F.col("up").isNotNull()).limit(1).count():
        above = paths.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("chosen").alias("higher"))
        paths = store(paths.join(above, "up", "left").select(
            "cluster", F.col("further").alias("up"), F.coalesce("higher", "chosen").alias("chosen")), "density-paths")
    return paths.select("cluster", "chosen")


def density_clusters(graph: DataFrame, nodes: DataFrame, min_size: int = 3, min_samples: int = 3) -> DataFrame:
    """``row, cluster, probability`` of ``nodes`` (row) from a neighbour graph
    (``row, other, d, rank``); cluster null and probability 0 for noise.

    The probability is the row's own level over its cluster's highest, at most 1.
    """
    clusters, rows, _ = condense(nodes, reachability_edges(graph, min_samples), min_size)
    chosen = choose(clusters).where(F.col("chosen").isNotNull())
    tops = clusters.select(F.col("cluster").alias("chosen"), "top")
    found = rows.join(chosen, "cluster").join(tops, "chosen").select(
        "row", F.col("chosen").alias("cluster"), (F.least("level", "top") / F.col("top")).alias("probability"))
    return nodes.select("row").join(found, "row", "left").select(
        "row", "cluster", F.coalesce("probability", F.lit(0.0)).alias("probability"))
