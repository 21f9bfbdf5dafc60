"""Hard negatives by shared, bounded candidate lists per anchor cluster (MAXIMUS).

Anchors are clustered by direction.  For a cluster with centre c and widest member
angle b, a candidate x at angle t to c scores at most ``|a| |x| cos(max(0, t - b))``
with any member a.  The candidates are put in order of that bound once per cluster;
every member walks the shared list and stops at the first candidate whose bound
cannot reach what the member still needs.  Each stop is certified, so the result is
that of scoring every candidate.

* Scores are integer inner products of ``floor(scale * x)``, computed in blocks by
  matrix products that are exact below 2**53 (as 64-bit integers beyond).
* Two searches: an anchor's best rows of its label (positives), then per positive
  the best rows of other labels inside its score window (negatives).  Both walk the
  same lists; a window's lower end counts as a need from the start.
* A cluster's list is cut into bands of the bound, a band into slices of about
  ``SLICE`` rows (by hash, so equal vectors spread too), a cluster's members into
  chunks of about ``MEMBERS``.  A task gets one chunk and one slice, whatever share
  of the rows a cluster, a label or one vector holds.  The leading bands are walked
  first; candidates of the others travel only where a member's need is within reach.
* Sent to all tasks: centres and per-band counts, at most ``CLUSTERS`` x ``BANDS``
  numbers each.  The centres are fitted on at most ``SAMPLE`` anchors in hash order;
  they decide only how far walks go, never what is found.

On vectors without structure (angles between members as wide as to anything else)
bounds cut nothing, and the work is anchors x rows, in blocks.

Rows with a null id, label or vector, an empty vector, or a null or non-finite
component take no part, nor do rows whose vector has another width than most rows
(ties: the widest).  Rows are told apart by position, not by id: a repeated row can
be the positive of its twin.  Equal scores are ordered by id.  Extra columns are
ignored; without anchors, or with one label only, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, release

SAMPLE = 4096
CLUSTERS = 64
ANCHORS_PER_CLUSTER = 1024
MEMBERS = 2048
SLICE = 32_768
BANDS = 64
BLOCK = 1024
ANGLE_SLACK = 1e-6  # covers the rounding of arccos near 1
LEAST, MOST = -(1 << 62), 1 << 62

ROW = "row long, id long, label long, q array<int>"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]),
                                    pa.array(np.ascontiguousarray(m).ravel()))


def prepare(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: float) -> tuple[DataFrame, int]:
    """The rows that take part (stored) and their width."""
    vec = F.col(vec_col)
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & sound)
    common = valid.groupBy(F.size(vec).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    q = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))
    found = valid.where(F.size(vec) == width).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"), q.alias("q"))
    return materialise(found, "op12-rows"), width


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero vectors stay zero) and lengths."""
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.maximum(norm, 1e-300)[:, None], norm


def angles(directions: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over a bounded sample, begun at evenly spaced rows."""
    x, _ = unit(sample)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        fresh, length = unit(sums)
        centres = np.where(length[:, None] > 0, fresh, centres)
    return centres


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                direction, norm = unit(matrix(b.column(3), centres.shape[1]))
                a = angles(direction, centres)
                nearest = np.argmin(a, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(nearest.astype(np.int32)), pa.array(a[np.arange(len(a)), nearest]), pa.array(norm)],
                    names=["row", "id", "label", "q", "cluster", "angle", "norm"])
    return run


class Lists:
    """The shared lists: which band and slice of a cluster's list a candidate is in."""

    def __init__(self, centres: np.ndarray, widest: np.ndarray, longest: float):
        self.centres, self.widest, self.longest = centres, widest, longest
        self.salts = np.zeros((len(centres), BANDS), np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Bound over the members' lengths, per row and cluster."""
        direction, norm = unit(q)
        gap = np.maximum(angles(direction, self.centres) - self.widest - ANGLE_SLACK, 0.0)
        return norm[:, None] * np.cos(gap) + 1e-6 * norm[:, None]

    def bands(self, bounds: np.ndarray) -> np.ndarray:
        top = max(self.longest, 1e-300) * (1 + 1e-6)
        return np.clip(((top - bounds) / (2 * top) * BANDS).astype(np.int64), 0, BANDS - 1)


def _count_bands(lists: Lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(lists.centres)
        total = np.zeros(k * BANDS, np.int64)
        for b in batches:
            if b.num_rows:
                band = lists.bands(lists.bounds(matrix(b.column(0), lists.centres.shape[1])))
                total += np.bincount((band + np.arange(k) * BANDS).ravel(), minlength=k * BANDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BANDS).astype(np.int32)), pa.array((at % BANDS).astype(np.int32)),
                                          pa.array(total[at])], names=["cluster", "band", "n"])
    return run


def _deal(lists: Lists, wanted: np.ndarray, needs: np.ndarray):
    """Candidates of each cluster's wanted bands whose bound reaches the cluster's least need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = np.arange(len(lists.centres))
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                q = matrix(b.column(3), lists.centres.shape[1])
                bounds = lists.bounds(q)
                band = lists.bands(bounds)
                r, c = np.nonzero(wanted[clusters, band] & (bounds >= needs))
                if not len(r):
                    continue
                rows = b.column(0).to_numpy()
                mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                salt = mixed[r] % np.maximum(lists.salts[c, band[r, c]], 1).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(band[r, c].astype(np.int32)), pa.array(salt.astype(np.int64)),
                     *(b.column(i).take(pa.array(r)) for i in range(3)), pa.array(bounds[r, c]), _lists(q[r])],
                    names=["cluster", "band", "salt", "row", "id", "label", "bound", "q"])
    return run


DEALT = "cluster int, band int, salt long, row long, id long, label long, bound double, q array<int>"
FOUND = "row long, slot int, other long, score long"


def best_of(kept: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` by (score descending, id) of each (member, slot)."""
    member, slot, score, other = kept
    order = np.lexsort((other, -score, slot, member))
    member, slot, score, other = (x[order] for x in (member, slot, score, other))
    fresh = np.r_[True, (member[1:] != member[:-1]) | (slot[1:] != slot[:-1])][: len(member)]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(member)), 0))
    keep = np.arange(len(member)) - begin < k
    return [x[keep] for x in (member, slot, score, other)]


def walk(members: dict, candidates: dict, same: bool, k: int, exact: bool) -> list[np.ndarray]:
    """Each member's best ``k`` candidates per slot: ``member, slot, score, other``.

    ``members``: row, label, q, norm, and per slot (columns) low, high and need.
    ``candidates``: row, id, label, bound, q in order of falling bound.
    """
    kind = np.float64 if exact else np.int64
    mq, need = members["q"].astype(kind), np.maximum(members["low"], members["need"]).astype(np.float64)
    high = members["high"].astype(np.float64)
    slots = need.shape[1]
    kept = [np.zeros(0, np.int64) for _ in range(4)]
    live = np.arange(len(mq))
    for at in range(0, len(candidates["row"]), BLOCK):
        part = slice(at, at + BLOCK)
        reach = members["norm"][live] * candidates["bound"][at]
        live = live[((need[live] <= reach[:, None] + 1e-3) & (need[live] <= high[live])).any(axis=1)]
        if not len(live):
            break
        score = mq[live] @ candidates["q"][part].astype(kind).T
        fits = members["label"][live][:, None] == candidates["label"][part][None, :]
        if same:
            fits &= members["row"][live][:, None] != candidates["row"][part][None, :]
        else:
            fits = ~fits
        grown = False
        for s in range(slots):
            r, c = np.nonzero(fits & (score >= need[live, s][:, None]) & (score <= high[live, s][:, None]))
            if len(r):
                grown = True
                fresh = (live[r], np.full(len(r), s), score[r, c].astype(np.int64), candidates["id"][part][c])
                kept = [np.concatenate(x) for x in zip(kept, fresh)]
        if grown:
            kept = best_of(kept, k)
            key = kept[0] * slots + kept[1]
            full, first, n = np.unique(key, return_index=True, return_counts=True)
            last = kept[2][(first + n - 1)[n == k]].astype(np.float64)
            m, s = full[n == k] // slots, full[n == k] % slots
            need[m, s] = np.maximum(need[m, s], last)
    return kept


def _search(same: bool, k: int, exact: bool, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = [np.zeros(0, np.int64)] * 4
        rows = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            column = lambda t, name: t.column(name).combine_chunks()
            slots = len(left.column("low")[0])
            rows = column(left, "row").to_numpy()
            members = {"row": rows, "label": column(left, "label").to_numpy(), "norm": column(left, "norm").to_numpy(),
                       "q": matrix(left.column("q"), width)} | {x: matrix(left.column(x), slots) for x in ("low", "high", "need")}
            order = np.lexsort((column(right, "id").to_numpy(), -column(right, "bound").to_numpy()))
            listed = {x: column(right, x).to_numpy()[order] for x in ("row", "id", "label", "bound")}
            kept = walk(members, listed | {"q": matrix(right.column("q"), width)[order]}, same, k, exact)
        return pa.table({"row": pa.array(rows[kept[0]], pa.int64()), "slot": pa.array(kept[1], pa.int32()),
                         "other": pa.array(kept[3], pa.int64()), "score": pa.array(kept[2], pa.int64())})
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Index:
    """Anchors in clusters, and the lists that they share."""

    def __init__(self, rows: DataFrame, width: int, is_anchor: Column):
        self.rows, self.width = rows, width
        anchors = rows.where(is_anchor)
        n = anchors.count()
        sample = anchors.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("q").toArrow().column(0)
        k = min(CLUSTERS, max(1, -(-n // ANCHORS_PER_CLUSTER)), max(len(sample), 1))
        centres = fit_centres(matrix(sample, width), k) if len(sample) else np.zeros((1, width))
        self.members = materialise(anchors.select("row", "id", "label", "q").mapInArrow(
            _assign(centres), ROW + ", cluster int, angle double, norm double"), "op12-anchors")
        groups = self.members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()
        size, widest = np.zeros(k, np.int64), np.zeros(k)
        for g in groups:
            size[g.cluster], widest[g.cluster] = g.n, g.angle
        largest, longest = rows.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("long"))))),
                                    F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
        if (largest or 0) ** 2 * width >= MOST:
            raise ValueError("inner products exceed 64 bits")
        self.exact = (largest or 0) ** 2 * width < 1 << 53
        self.lists = Lists(centres, widest, longest or 0.0)
        counted = rows.select("q").mapInArrow(_count_bands(self.lists), "cluster int, band int, n long")
        self.counts = np.zeros((k, BANDS), np.int64)
        for r in counted.groupBy("cluster", "band").agg(F.sum("n").alias("n")).collect():
            self.counts[r.cluster, r.band] = r.n if size[r.cluster] else 0
        self.lists.salts = -(-self.counts // SLICE)
        self.chunks = [int(x) for x in np.maximum(-(-size // MEMBERS), 1)]
        # leading bands up to a slice's worth of rows, one at least
        before = np.cumsum(self.counts, axis=1) - self.counts
        self.head = (before < SLICE) & (self.counts > 0)

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """``row, slot, other, score, rank``: the best k of each query row and slot.

        ``queries`` (stored): the columns of members, and ``low, high`` arrays of slots."""
        blank = F.transform("low", lambda _: F.lit(LEAST).cast("long"))
        first = materialise(self._round(queries.withColumn("need", blank), self.head, np.full(len(self.chunks), -np.inf), same, k),
                            "op12-head")
        rest = ~self.head & (self.counts > 0)
        if not rest.any():
            return _top(first, k)
        # the k-th best so far of each slot is what the rest of the list must reach
        found = (_top(first, k).where(F.col("rank") == k).groupBy("row")
                 .agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth")))
        known = queries.join(found, "row", "left").withColumn(
            "need", F.transform("low", lambda x, i: F.coalesce(F.col("kth")[i.cast("int")], F.lit(LEAST)).cast("long"))).drop("kth")
        known = materialise(known, "op12-needs")
        least = F.array_min(F.zip_with("low", "need", lambda a, b: F.greatest(a, b).cast("double")))
        reach = F.when(F.col("norm") > 0, least / F.col("norm")).otherwise(F.when(least <= 0, F.lit(float("-inf")))
                                                                         .otherwise(F.lit(float("inf"))))
        needs = np.full(len(self.chunks), np.inf)
        for r in known.groupBy("cluster").agg(F.min(reach).alias("reach")).collect():
            needs[r.cluster] = r.reach - 1e-3
        second = self._round(known, rest, needs, same, k)
        return _top(first.unionByName(second), k)

    def _round(self, queries: DataFrame, wanted: np.ndarray, needs: np.ndarray, same: bool, k: int) -> DataFrame:
        spark = queries.sparkSession
        chunks = F.element_at(F.array(*[F.lit(c) for c in self.chunks]), F.col("cluster") + 1)
        dealt = self.rows.select("row", "id", "label", "q").mapInArrow(_deal(self.lists, wanted, needs), DEALT)
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        slices = [(int(c), int(b), int(self.lists.salts[c, b])) for c, b in zip(*np.nonzero(wanted))]
        slices = F.broadcast(spark.createDataFrame(slices, "cluster int, band int, salts long"))  # CLUSTERS x BANDS rows at most
        asked = (queries.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int")).join(slices, "cluster")
                        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))))
        keys = ["cluster", "band", "salt", "chunk"]
        asked = asked.select(*keys, "row", "label", "q", "norm", "low", "high", "need")
        return (asked.groupBy(*keys).cogroup(dealt.groupBy(*keys))
                     .applyInArrow(_search(same, k, self.exact, self.width), FOUND))


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``.  Per anchor and each of its best
    ``positives`` rows of the same label, the best ``negatives`` rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    stored, width = prepare(rows, id_col, label_col, vec_col, scale)
    index = _Index(stored, width, is_anchor)
    everything = [F.array(F.lit(x).cast("long")) for x in (LEAST, MOST)]
    queries = index.members.withColumns({"low": everything[0], "high": everything[1]})
    best = index.search(queries, True, positives)
    best = materialise(best.select("row", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")),
                       "op12-positives")
    # a window's ends, in whole numbers; below 0 the upper end lies under the lower one
    p = F.col("positive_score")
    windows = best.where(p >= 0).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "positive_id", "positive_score", F.expr(f"positive_score div 100 * {low} + (positive_score % 100 * {low} + 99) div 100").alias("low"),
        F.expr(f"positive_score div 100 * {high} + (positive_score % 100 * {high}) div 100").alias("high")))).alias("w"))
    asked = materialise(index.members.join(windows, "row").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}),
                        "op12-windows")
    found = index.search(asked.drop("w"), False, negatives)
    named = asked.select("row", F.col("id").alias("anchor_id"), F.posexplode("w").alias("slot", "p"))
    out = materialise(found.join(named, ["row", "slot"]).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score")), "op12-result")
    release(stored)
    return out
