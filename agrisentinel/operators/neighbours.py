"""k-nearest-neighbour joins (C8): exact for a stated query set, indexed for all rows.

``exact_neighbours`` holds every query against every row, in blocks: queries in
chunks of about ``QUERIES``, rows in slices of about ``SLICE`` (both dealt by hash),
one (chunk, slice) a task; only each query's best k of a slice leave the task.

``neighbour_graph`` finds the neighbours of all rows with several tables of buckets:

* A table is a tree of random hyperplanes, each through the median of its node, so
  near rows tend to share a leaf.  The medians of the first levels come from a
  sample of at most ``SAMPLE`` rows; a leaf that still holds more than twice
  ``leaf`` rows is split further at its own median, or by hash where all its rows
  lie on one point, until none does.  Every row is in one leaf of each table.
* Rows of a leaf are compared in one task; only each row's best k leave it.
* The best of all tables are merged.  Recall is measured against an exact search
  for at most ``CHECKED`` rows.  Below the wanted recall, one round of neighbours of
  neighbours follows (the neighbours of a row are compared among each other, and
  what improves on their lists is kept); then two tables at a time with leaves
  twice as wide, up to ``WIDEST`` rows.  If that does not reach it either, a
  warning tells the recall that was measured.

Tables, recall and refinement work on stored rows, so a lost executor costs the
task only.  Distances are recomputed from the components for what is kept, so the
same pair has the same distance wherever it was met; ties go to the smaller id.

Rows with a null id or vector, an empty vector, or a null or non-finite component
take no part, nor do rows of another width than most.  Rows of one id are told
apart by position.  A row is not its own neighbour; fewer than k others give fewer.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

QUERIES = 2048
SLICE = 32_768
SAMPLE = 1 << 16
LEAF = 4096
WIDEST = 1 << 16
DEPTH = 10      # levels fitted on the sample
CHECKED = 256
CELLS = 1 << 21  # distances that a task holds at a time


def matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


@dataclass
class Vectors:
    """The rows that take part (``row, id, vec``), stored; their width and metric."""

    rows: DataFrame
    width: int
    metric: str


def prepare(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine") -> Vectors:
    """``metric`` is "cosine" (1 - cosine of unit vectors) or "euclidean"."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    rows = rows.where(F.size("vec") == width)
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("n", norm).select("id", F.transform("vec", lambda x: F.when(
            F.col("n") > 0, x / F.col("n")).otherwise(x)).alias("vec"))
    return Vectors(store(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "knn-rows"), width, metric)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, from the components."""
    s = ((a - b) ** 2).sum(axis=1)
    return s / 2 if metric == "cosine" else np.sqrt(s)


def nearest(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int,
            metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of ``x`` for each of ``q`` (ties by id): query places, places in x, distances."""
    out = []
    half = (x * x).sum(axis=1) / 2
    block = max(1, CELLS // max(len(x), 1))
    for at in range(0, len(q), block):
        part = q[at: at + block]
        closeness = part @ x.T - half  # falls with the distance
        closeness[q_row[at: at + block][:, None] == x_row[None, :]] = -np.inf
        n = min(k, len(x))
        kth = np.partition(closeness, len(x) - n, axis=1)[:, len(x) - n]
        kth = np.where(np.isneginf(kth), -np.inf, kth - 1e-9 * (1 + np.abs(kth)))
        r, c = np.nonzero((closeness >= kth[:, None]) & ~np.isneginf(closeness))
        d = np.round(distances(part[r], x[c], metric), 12)
        order = np.lexsort((x_id[c], d, r))
        r, c, d = r[order], c[order], d[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        out.append((at + r[rank < k], c[rank < k], d[rank < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out))


FOUND = "row long, other long, d double"


def _found(rows: np.ndarray, others: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"row": pa.array(rows, pa.int64()), "other": pa.array(others, pa.int64()), "d": pa.array(d, pa.float64())})


def _block(k: int, width: int, metric: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [])
        q_row, x_row = (t.column("row").to_numpy() for t in (left, right))
        q, c, d = nearest(matrix(left.column("vec"), width), q_row, matrix(right.column("vec"), width), x_row,
                          right.column("id").to_numpy(), k, metric)
        return _found(q_row[q], x_row[c], d)
    return run


def _best(found: DataFrame, v: Vectors, k: int) -> DataFrame:
    """``row, other, other_id, d, rank``."""
    ids = v.rows.select(F.col("row").alias("other"), F.col("id").alias("other_id"))
    order = Window.partitionBy("row").orderBy("d", "other_id", "other")
    return found.join(ids, "other").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def against(v: Vectors, asked: DataFrame, k: int, chunk: int | None = None) -> DataFrame:
    """``row, other, other_id, d, rank`` of query vectors (``row, vec``, stored) against all rows of ``v``.

    A query is not compared with the row of its own number."""
    chunks, slices = (max(1, -(-df.count() // size)) for df, size in ((asked, chunk or QUERIES), (v.rows, SLICE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = asked.select("row", "vec", own(chunks).alias("chunk")).withColumn("slice", every(slices))
    right = v.rows.select("row", "id", "vec", own(slices).alias("slice")).withColumn("chunk", every(chunks))
    found = (left.groupBy("chunk", "slice").cogroup(right.groupBy("chunk", "slice"))
                 .applyInArrow(_block(k, v.width, v.metric), FOUND))
    return _best(found, v, k)


def exact_neighbours(v: Vectors, queries: DataFrame, k: int) -> DataFrame:
    """``row, other, other_id, d, rank``: ``queries`` (column ``row``) against all rows."""
    return against(v, store(v.rows.join(queries.select("row"), "row", "left_semi"), "knn-queries"), k)


# --- tables of buckets ------------------------------------------------------------------

def fit_tables(sample: np.ndarray, tables: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A direction per table and level, and the median of each node (heap order)."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(tables, max(depth, 1), sample.shape[1]))
    cuts = np.zeros((tables, 1 << depth))
    for t in range(tables):
        node = np.ones(len(sample), np.int64)
        for level in range(depth):
            p = sample @ directions[t, level]
            for n in range(1 << level, 2 << level):
                here = p[node == n]
                cuts[t, n] = np.median(here) if len(here) else 0.0
            node = 2 * node + (p > cuts[t, node])
    return directions, cuts


def _deal(directions: np.ndarray, cuts: np.ndarray, first: int):
    tables, depth, width = directions.shape
    depth = int(math.log2(cuts.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width) if b.num_rows else np.zeros((0, width))
            for t in range(tables):
                node = np.ones(len(x), np.int64)
                for level in range(depth):
                    node = 2 * node + (x @ directions[t, level] > cuts[t, node])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.full(len(x), first + t, np.int32)), pa.array(node.astype(np.float64).astype(np.int64))],
                    names=["row", "id", "vec", "tab", "node"])
    return run


def _split_wide(dealt: DataFrame, most: int, width: int, seed: int) -> DataFrame:
    """Halve leaves of more than ``most`` rows, at a median or by hash, until there is none."""
    rng = np.random.default_rng(seed)
    while True:
        wide = store(dealt.groupBy("tab", "node").count().where(F.col("count") > most).select("tab", "node"), "knn-wide")
        if not wide.limit(1).count():
            return dealt
        direction = F.array(*[F.lit(float(x)) for x in rng.normal(size=width)])
        p = F.aggregate(F.zip_with("vec", direction, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        inside = dealt.join(wide, ["tab", "node"], "left_semi").withColumn("p", p)
        cut = (inside.groupBy("tab", "node").agg(F.percentile_approx("p", 0.5, 1000).alias("cut"), F.max("p").alias("top")))
        # a median that is also the maximum leaves the other half empty: such leaves are halved by hash
        side = F.when(F.col("cut") < F.col("top"), F.col("p") > F.col("cut")).otherwise(
            F.pmod(F.xxhash64("row", "node"), F.lit(2)) == 1)
        halves = inside.join(cut, ["tab", "node"]).withColumn("node", 2 * F.col("node") + side.cast("long"))
        rest = dealt.join(wide, ["tab", "node"], "left_anti")
        dealt = store(rest.unionByName(halves.select(*rest.columns)), "knn-leaves")


def _leaf(k: int, width: int, metric: str):
    def run(leaf: pa.Table) -> pa.Table:
        rows, x = leaf.column("row").to_numpy(), matrix(leaf.column("vec"), width)
        q, c, d = nearest(x, rows, x, rows, leaf.column("id").to_numpy(), k, metric)
        return _found(rows[q], rows[c], d)
    return run


def bucket_pairs(v: Vectors, k: int, tables: int, leaf: int, n: int, seed: int) -> DataFrame:
    """``row, other, d``: best k of each row in its leaf of each table (stored)."""
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    sample = v.rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vec").toArrow() if depth else None
    fitted = matrix(sample.column(0), v.width) if depth else np.zeros((0, v.width))
    directions, cuts = fit_tables(fitted, tables, depth, seed)
    dealt = v.rows.mapInArrow(_deal(directions, cuts, 0), f"row long, id {dict(v.rows.dtypes)['id']}, vec array<double>, tab int, node long")
    if n > leaf:
        dealt = _split_wide(store(dealt, "knn-dealt"), 2 * leaf, v.width, seed + 1)
    return store(dealt.groupBy("tab", "node").applyInArrow(_leaf(k, v.width, v.metric), FOUND), "knn-pairs")


def merge(found: DataFrame, v: Vectors, k: int) -> DataFrame:
    """Best k of each row among pairs that may repeat (stored)."""
    return store(_best(found.distinct(), v, k).select("row", "other", "other_id", "d", "rank"), "knn-graph")


def _among(width: int, metric: str):
    """Pairs among each row's neighbours that improve on the list of either."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                members = b.column(0)[i].values
                rows, kth = members.field("other").to_numpy(), members.field("kth").to_numpy()
                x = matrix(members.field("vec"), width)
                a, c = np.nonzero(~np.eye(len(rows), dtype=bool))
                d = np.round(distances(x[a], x[c], metric), 12)
                better = d < kth[a]
                if better.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a[better]]), pa.array(rows[c[better]]), pa.array(d[better])],
                                                     names=["row", "other", "d"])
    return run


def refine(graph: DataFrame, v: Vectors, k: int) -> DataFrame:
    """One round of neighbours of neighbours: the members of each row's list meet."""
    kth = graph.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("kth"))
    known = v.rows.select("row", "vec").join(kth, "row").withColumnRenamed("row", "other")
    lists = (graph.select("row", "other").join(known, "other").groupBy("row")
                  .agg(F.collect_list(F.struct("other", "kth", "vec")).alias("members")))
    fresh = lists.select("members").mapInArrow(_among(v.width, v.metric), FOUND)
    return merge(graph.select("row", "other", "d").unionByName(fresh), v, k)


def measured_recall(graph: DataFrame, exact: DataFrame, k: int) -> float:
    """Share of the true neighbours' places that the graph fills (equal distances count)."""
    kth = exact.groupBy("row").agg(F.max("d").alias("kth"), F.count(F.lit(1)).alias("n"))
    near = graph.join(kth, "row").where(F.col("d") <= F.col("kth")).groupBy("row").agg(F.count(F.lit(1)).alias("hit"))
    return kth.join(near, "row", "left").agg(
        F.sum(F.least(F.coalesce("hit", F.lit(0)), "n")) / F.sum("n")).first()[0] or 0.0


def neighbour_graph(v: Vectors, k: int, recall: float = 0.9, tables: int = 4, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """``row, other, other_id, d, rank`` of every row (stored)."""
    n = v.rows.count()
    graph = merge(bucket_pairs(v, k, 1 if n <= leaf else tables, leaf, n, seed), v, k)
    if n <= leaf:
        return graph  # one leaf holds all rows: exact
    checked = v.rows.select("row").orderBy(F.xxhash64("row", F.lit(seed))).limit(CHECKED)
    exact = store(exact_neighbours(v, checked, k), "knn-exact")
    if (reached := measured_recall(graph, exact, k)) < recall:
        graph = refine(graph, v, k)
        reached = measured_recall(graph, exact, k)
    while reached < recall and leaf < min(WIDEST, n):
        leaf, seed = 2 * leaf, seed + 1
        more = bucket_pairs(v, k, 2, leaf, n, seed)
        graph = merge(graph.select("row", "other", "d").unionByName(more), v, k)
        reached = measured_recall(graph, exact, k)
    if reached < recall:
        warnings.warn(f"neighbour graph: recall {reached:.3f} of {len(exact.select('row').distinct().collect())} checked rows, "
                      f"{recall} wanted", stacklevel=2)
    return graph


def knn_join(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine",
             queries=None, **options) -> DataFrame:
    """``id, rank, neighbour_id, distance``.

    ``queries`` is a condition on ``id``: those rows against all rows, exact.
    Without it, all rows by the index.
    """
    v = prepare(df, id_col, vec_col, metric)
    if queries is not None:
        found = exact_neighbours(v, v.rows.where(queries), k)
    else:
        found = neighbour_graph(v, k, **options)
    names = v.rows.select("row", "id")
    return found.join(names, "row").select("id", "rank", F.col("other_id").alias("neighbour_id"), F.col("d").alias("distance"))
