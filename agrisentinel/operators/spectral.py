"""Neighbour-preserving reduction (J2, J3): leading eigenvectors of the neighbour graph.

Rows that are neighbours get near coordinates: the coordinates are the eigenvectors
of the normalised graph with the largest eigenvalues below the trivial one (Laplacian
eigenmaps), found by a restarted block Krylov iteration.

* The graph is the symmetric union of the neighbour lists, every edge of weight 1.
* A round multiplies a block of vectors ``STEPS`` times by the graph S, as joins on the
  sparse edge table with partial sums, and keeps each product.  From their inner
  products alone (a few hundred numbers, summed in one pass) follow the best vectors
  in the space that all of them span; those are the next round's block.
* It ends when no wanted Rayleigh quotient grows by more than ``tolerance``; they grow
  towards bounds, so it always ends.

Several parts of the graph that no edge joins have trivial vectors of their own; those
come out as coordinates that tell the parts apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .neighbours import matrix

STEPS = 6
SPARE = 3


def graph_edges(graph: DataFrame) -> DataFrame:
    """``u, v, s`` in both directions from ``row, other``: the normalised adjacency (stored)."""
    pairs = graph.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).where("a != b").distinct()
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).cast("double").alias("d"))
    joined = both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    return store(joined.select("u", "v", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("s"), "d"), "spectral-edges")


def _multiply(edges: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """``row, y`` of S times the block; every row has an edge."""
    met = edges.join(block.select(F.col("row").alias("v"), "y"), "v")
    sums = met.groupBy(F.col("u").alias("row")).agg(*[F.sum(F.col("s") * F.col("y")[i]).alias(f"y{i}") for i in range(width)])
    return sums.select("row", F.array(*[F.col(f"y{i}") for i in range(width)]).alias("z"))


def _products(rows: DataFrame, columns: int) -> np.ndarray:
    """Inner products of the columns of ``all`` (an array per row), summed per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for b in batches:
            a = matrix(b.column(0), columns)
            total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns * columns, dtype=np.int32)), pa.array(total.ravel())],
                                         names=["place", "x"])
    out = np.zeros(columns * columns)
    for r in rows.select("all").mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
        out[r.place] = r.x
    return out.reshape(columns, columns)


def _combined(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """``row, y``: the first columns of ``all`` times a small matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = matrix(b.column(1), len(b.column(1)[0]))[:, : len(m)] @ m
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["row", "y"])
    return rows.select("row", "all").mapInArrow(run, "row long, y array<double>")


def _best(gram: np.ndarray, h: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest Rayleigh quotients in the spanned space and the combinations that have them."""
    values, vectors = np.linalg.eigh(gram)
    sound = values > values.max() * 1e-12
    base = vectors[:, sound] / np.sqrt(values[sound])
    quotients, turn = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
    order = np.argsort(-quotients)[:keep]
    return quotients[order], base @ turn[:, order]


def spectral_coordinates(graph: DataFrame, nodes: DataFrame, dims: int, tolerance: float = 1e-3, seed: int = 42) -> DataFrame:
    """``row, coords`` of ``nodes`` (row): ``dims`` coordinates; zeros for a row without neighbours."""
    edges = graph_edges(graph)
    weight = edges.select(F.col("u").alias("row"), "d").distinct()
    total, n = weight.agg(F.sum("d"), F.count(F.lit(1))).first()
    none = F.array(*[F.lit(0.0)] * dims)
    if not n:
        return nodes.select("row", none.alias("coords"))
    weight = store(weight.select("row", F.sqrt(F.col("d") / total).alias("t"), "d"), "spectral-weight")
    width = min(dims + SPARE, n)
    start = F.array(*[F.xxhash64("row", F.lit(seed), F.lit(i)) / F.lit(float(1 << 63)) for i in range(width)])
    block, before = weight.select("row", start.alias("y")), None
    while True:
        # without the trivial vector t, which products bring back only by rounding
        flat = block.join(weight.select("row", "t"), "row")
        share = flat.agg(*[F.sum(F.col("t") * F.col("y")[i]) for i in range(width)]).first()
        block = store(flat.select("row", F.array(*[F.col("y")[i] - F.lit(float(share[i] or 0.0)) * F.col("t") for i in range(width)])
                                  .alias("y")), "spectral-block")
        rows, last = block.select("row", F.col("y").alias("all")), block
        for _ in range(STEPS):
            last = store(_multiply(edges, last, width).withColumnRenamed("z", "y"), "spectral-product")
            rows = rows.join(last, "row").select("row", F.concat("all", "y").alias("all"))
        rows = store(rows, "spectral-space")
        g, held = _products(rows, width * (STEPS + 1)), width * STEPS
        quotients, best = _best(g[:held, :held], g[:held, width: width + held], width)
        if best.shape[1] < width:
            best = np.hstack([best, np.zeros((held, width - best.shape[1]))])
        block, wanted = _combined(rows, best), quotients[:dims]
        if before is not None and len(before) == len(wanted) and (wanted - before).max() <= tolerance:
            break
        before = wanted
    turn = np.eye(width)[:, : min(dims, len(wanted))]
    if turn.shape[1] < dims:
        turn = np.hstack([turn, np.zeros((width, dims - turn.shape[1]))])
    # per unit of degree, so that a row lies at the mean of its neighbours
    found = (_combined(block.select("row", F.col("y").alias("all")), turn).join(weight.select("row", "d"), "row")
             .select("row", F.transform("y", lambda y: y / F.sqrt("d") * F.lit(float(np.sqrt(total)))).alias("coords")))
    return nodes.select("row").join(found, "row", "left").select("row", F.coalesce("coords", none).alias("coords"))


def preservation(graph: DataFrame, reduced: DataFrame) -> DataFrame:
    """``preserved``: share of the rows' neighbours (``row, other``) that are neighbours after the reduction too."""
    kept = graph.select("row", "other").join(reduced.select("row", "other"), ["row", "other"], "left_semi")
    return graph.select(F.count(F.lit(1)).alias("n")).select(
        (kept.select(F.count(F.lit(1))).scalar() / F.col("n")).alias("preserved"))
