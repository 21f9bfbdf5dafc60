"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``DIMS`` places: byte 1- to 3-grams
of the text, and 1- to 3-grams of word shapes (letter case, digits, trailing or
inner signs, "same as the word before").  They are scaled by the class
log-count ratios (smoothed counts over all training rows, summed by Spark) and
each row to unit length.

The linear hinge-loss model is fitted by dual coordinate descent.  Training rows
are dealt by a hash into shards of about ``SHARD_ROWS`` rows; every shard runs
its own descent and the weights are averaged, so all labelled rows count and
memory does not grow with them.  A logistic curve fitted to the training rows'
margins (from a histogram) turns margins into scores.

Only the text is an input of a score.  Null and empty texts have no n-gram: they
get the bias alone, a score like any other.  Conflicting labels of one id count
by majority (ties: 1), null labels not at all.  Without a training row of each
class every score is the share of label 1 (0.5 without any).  Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tables import broadcast_if_small, materialise, own_names

U = np.uint64
DIMS = 1 << 16
SHARD_ROWS = 2000
BIN = 50  # margin bins per unit

_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1   # upper
_KIND[97:123] = 2  # lower
_KIND[48:58] = 4   # digit
_KIND[128:] = 2    # other letters
for _c in b".,;:'\"()-":
    _KIND[_c] = 8  # common signs
_KIND[_KIND == 0] = 16
_KIND[H.SPACE] = 0


def _place(x: np.ndarray) -> np.ndarray:
    return (H.mix(x) >> U(48)).astype(np.int64)


def _grams(codes: np.ndarray, first: np.ndarray, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of 1- to 3-grams of ``codes`` with the index they begin at; a gram
    does not run over a position in ``first`` (where a document begins)."""
    out, value = [], np.zeros(len(codes), U)
    for n in range(3):
        size = max(0, len(codes) - n)
        value = value[:size] * U(0x100000001B3) + codes[n:].astype(U) + U(1)
        ok = np.ones(size, bool)
        for j in range(1, n + 1):
            cut = first - j
            ok[cut[(cut >= 0) & (cut < size)]] = False
        at = np.flatnonzero(ok)
        out.append((_place(value[at] + U((salt + n) * 0x9E3779B97F4A7C15 % (1 << 64))), at))
    return out


def features(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The n-gram indicators (sorted places) of each document."""
    starts, ends, counts = H.word_bounds(buf, off)
    p = H.prefix_sums(buf)
    word = H.range_hash(p, starts, ends)
    kinds = np.zeros(len(buf) + 1, np.int64)
    kinds[:-1] = _KIND[buf]
    bits = np.zeros(len(starts), np.int64)
    for bit in (1, 2, 4, 8, 16):
        c = np.r_[0, np.cumsum((kinds[:-1] & bit) > 0)]
        bits |= np.where(c[ends] > c[starts], bit, 0)
    same = np.zeros(len(starts), bool)
    same[1:] = word[1:] == word[:-1]
    first_word = np.cumsum(counts) - counts
    same[first_word[counts > 0]] = False
    shape = bits + 32 * same + 64 * np.minimum(ends - starts, 3)
    parts = [(x, at) for x, at in _grams(buf, off[1:-1], 10)]
    word_doc = np.repeat(np.arange(len(counts)), counts)
    shape_parts = _grams(shape, first_word[1:], 20)
    flags = np.zeros(DIMS, bool)
    edges = [np.searchsorted(at, off) for _, at in parts]
    shape_edges = [np.searchsorted(word_doc[at], np.arange(len(counts) + 1)) for _, at in shape_parts]
    out = []
    for d in range(len(off) - 1):
        for (x, _), e in zip(parts + shape_parts, edges + shape_edges):
            flags[x[e[d]: e[d + 1]]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        out.append(found)
    return out


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    buf, off = H.text_bytes(batch.column(column))
    for i, j in H.chunks(off):
        yield i, features(buf[off[i]: off[j]], off[i: j + 1] - off[i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(False)
        for i, docs in _documents(batch, 2):
            for d, found in enumerate(docs):
                counts[label[i + d], found] += 1
                rows[label[i + d]] += 1
    if rows.sum():
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, used]), pa.array(np.r_[rows[1], counts[1, used]]), pa.array(np.r_[rows[0], counts[0, used]])],
            names=["place", "pos", "neg"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: np.ndarray,
                            epochs: int = 12) -> np.ndarray:
    """Weights (last: bias) of the squared hinge loss; rows are scaled indicators.

    ``c`` is the cost of each row.
    """
    w = np.zeros(DIMS + 1)
    values = []
    for r in rows:
        v = ratio[r]
        norm = math.sqrt(float(v @ v))
        values.append(v / norm if norm else v)
    alpha = np.zeros(len(rows))
    curve = 1 / (2 * c)
    square = np.array([float(v @ v) for v in values]) + 1.0 + curve
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (float(w[r] @ v) + w[DIMS]) - 1 + alpha[i] * curve[i]
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[DIMS] += step
                alpha[i] = new
    return w


def _fit(ratio: np.ndarray, cost: tuple[float, float]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        label = table.column("label").to_numpy()
        rows: list[np.ndarray] = []
        for batch in table.combine_chunks().to_batches():
            for _, docs in _documents(batch, batch.schema.get_field_index("text")):
                rows += docs
        w = dual_coordinate_descent(rows, 2.0 * label - 1, ratio, np.where(label > 0, cost[1], cost[0]))
        used = np.flatnonzero(w)
        return pa.table({"place": used, "w": np.round(w[used], 9)})
    return run


def _margins(ratio: np.ndarray, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            for i, docs in _documents(batch, 1):
                for d, found in enumerate(docs):
                    v = ratio[found]
                    norm = math.sqrt(float(v @ v))
                    margin[i + d] = (float(w[found] @ v) / norm if norm else 0.0) + w[DIMS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(margin, 6))], names=["id", "margin"])
    return run


def logistic_curve(m: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(label 1) over margins, from weighted bins
    (targets pulled in from 0 and 1 by the class counts)."""
    hi, lo = (pos.sum() + 1) / (pos.sum() + 2), 1 / (neg.sum() + 2)
    a, b = 1.0, 0.0
    n = pos + neg
    t = pos * hi + neg * lo
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, s = t - n * p, n * p * (1 - p)
        h = np.array([[s @ (m * m) + 1e-6, s @ m], [s @ m, s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([r @ m, r.sum()]))
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string")) % 5) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> DataFrame:
    """``docs`` with ``held_out, score`` (double, 0 to 1).

    Rows with ``crc32(id) mod 5 = 0`` are held out: their labels are not read.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
                   .agg((F.avg(label_col) >= 0.5).cast("int").alias("label")).where(~held_out("id")))
    known = materialise(known, "op6-labels")
    train = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .join(broadcast_if_small(known, 40), "id").select("id", "label", "text"))
    counted = (train.mapInArrow(_count, "place long, pos long, neg long")
                    .groupBy("place").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect())  # DIMS + 1 rows at most
    pos, neg, rows = np.ones(DIMS), np.ones(DIMS), (0, 0)
    for r in counted:
        if r["place"] < 0:
            rows = (r["neg"], r["pos"])
        else:
            pos[r["place"]] += r["pos"]
            neg[r["place"]] += r["neg"]
    if not min(rows):
        share = (rows[1] + 0.5) / (sum(rows) + 1) if sum(rows) else 0.5
        return docs.withColumns({"held_out": F.coalesce(held_out(id_col), F.lit(False)), "score": F.lit(share)})
    ratio = np.log(pos / (rows[1] + 2)) - np.log(neg / (rows[0] + 2))
    # both classes weigh alike in all
    cost = (sum(rows) / (2 * rows[0]), sum(rows) / (2 * rows[1]))
    shards = max(1, sum(rows) // SHARD_ROWS)
    fitted = (train.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).alias("shard"))
                   .applyInArrow(_fit(ratio, cost), "place long, w double")
                   .groupBy("place").agg(F.sum("w").alias("w")).collect())  # DIMS + 1 rows at most
    w = np.zeros(DIMS + 1)
    for r in fitted:
        w[r["place"]] = round(r["w"] / shards, 9)
    score_train = train.select("id", "text").mapInArrow(_margins(ratio, w), "id long, margin double")
    bins = (score_train.join(broadcast_if_small(known, 40), "id")
                       .groupBy(F.round(F.col("margin") * BIN).alias("bin"))
                       .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
                       .orderBy("bin").collect())  # margins are bounded: a few hundred bins
    m, p, n = (np.array([float(r[c]) for r in bins]) for c in ("bin", "pos", "neg"))
    a, b = logistic_curve(m / BIN, p, n)
    margin = docs.mapInArrow(_with_margin(ratio, w, docs.columns.index(text_col)), _schema_with(docs, "_margin double"))
    return margin.withColumns({
        "held_out": F.coalesce(held_out(id_col), F.lit(False)),
        "score": 1 / (1 + F.exp(-(F.lit(a) * F.col("_margin") + F.lit(b))))}).drop("_margin")


def _schema_with(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType(list(docs.schema.fields) + list(StructType.fromDDL(more).fields))


def _with_margin(ratio: np.ndarray, w: np.ndarray, text_at: int):
    score = _margins(ratio, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], names=["id", "text"])
            margin = next(score(iter([two]))).column(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, margin], names=[*batch.schema.names, "_margin"])
    return run


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` (columns as they are) without the documents scored below ``threshold``."""
    rows, names, back = own_names(docs)
    scored = quality_scores(rows, labels.withColumnRenamed(id_col, names[id_col]), names[id_col], names[text_col])
    return scored.where(F.col("score") >= threshold).select(*back)
