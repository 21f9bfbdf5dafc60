"""Neighbour joins and density clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrisentinel.operators import components as CP
from agrisentinel.operators import density as DN
from agrisentinel.operators import neighbours as NB
from agrisentinel.operators import topics as TP

SCHEMA = "id long, embedding array<float>, row long, vec string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x", 9) for i, v in rows], SCHEMA)


def vectors(seed, n, d=8, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if groups:
        x = rng.normal(size=(groups, d))[rng.integers(groups, size=n)] * 4 + 0.4 * x
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def brute(rows, k, metric, only=lambda i: True):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    out = {}
    for a, i in enumerate(ids):
        if only(i):
            s = ((x - x[a]) ** 2).sum(axis=1)
            d = s / 2 if metric == "cosine" else np.sqrt(s)
            best = sorted((round(round(float(d[b]), 12), 9), ids[b]) for b in range(len(ids)) if b != a)[:k]
            out.setdefault(i, []).append(best)
    return out


def by_id(found):
    out = {}
    for r in found.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((round(r.distance, 9), r.neighbour_id))
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_one_leaf_is_exact(spark, metric):
    rows = vectors(1, 300)
    got = by_id(NB.knn_join(frame(spark, rows), 7, metric=metric))
    assert got == {i: v[0] for i, v in brute(rows, 7, metric).items()}


def test_queries_are_exact_in_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(NB, "QUERIES", 5)
    monkeypatch.setattr(NB, "SLICE", 60)
    rows = vectors(2, 400)
    got = by_id(NB.knn_join(frame(spark, rows), 5, queries=F.col("id") % 10 == 0))
    assert got == {i: v[0] for i, v in brute(rows, 5, "cosine", lambda i: i % 10 == 0).items()}


def recall(got, want):
    return np.mean([len({n for _, n in got.get(i, [])} & {n for _, n in v[0]}) / len(v[0]) for i, v in want.items()])


@pytest.mark.parametrize("groups", [0, 12])
def test_index_reaches_the_wanted_recall(spark, groups):
    rows = vectors(3, 1500, d=16, groups=groups)
    got = by_id(NB.knn_join(frame(spark, rows), 10, tables=2, leaf=100))
    assert len(got) == 1500 and all(len(v) == 10 for v in got.values())
    assert recall(got, brute(rows, 10, "cosine")) >= 0.88  # 0.9 measured on CHECKED rows


def test_neighbours_of_neighbours_improve(spark):
    rows = vectors(4, 800, d=6, groups=8)
    v = NB.prepare(frame(spark, rows))
    want = brute(rows, 10, "cosine")
    named = lambda g: g.join(v.rows.select("row", "id"), "row").select(
        "id", "rank", F.col("other_id").alias("neighbour_id"), F.col("d").alias("distance"))
    graph = NB.merge(NB.bucket_pairs(v, 10, 2, 60, 800, 1), v, 10)
    before, after = (recall(by_id(named(g)), want) for g in (graph, NB.refine(graph, v, 10)))
    assert after > before + 0.05


def test_leaves_are_split_until_they_are_small(spark, monkeypatch):
    """A third of the rows are one vector; no hyperplane divides them."""
    monkeypatch.setattr(NB, "DEPTH", 1)
    rows = vectors(5, 400)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    v = NB.prepare(frame(spark, rows))
    directions, cuts = NB.fit_tables(np.array([x for _, x in rows]), 2, 1, 3)
    dealt = NB.store(v.rows.mapInArrow(NB._deal(directions, cuts, 0), "row long, id long, vec array<double>, tab int, node long"), "t")
    out = NB._split_wide(dealt, 40, v.width, 7)
    sizes = [r["count"] for r in out.groupBy("tab", "node").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 2 * 600
    got = by_id(NB.knn_join(frame(spark, rows), 5, leaf=40))
    assert all(got[i][0][0] == 0.0 for i in range(1000, 1200))


def test_distances_are_held_in_bounded_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(50, 4)), rng.normal(size=(400, 4))
    asked = (q, -1 - np.arange(50), x, np.arange(400), np.arange(400), 5, "euclidean")
    whole = NB.nearest(*asked)
    held, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **kw: held.append(a.size) or partition(a, *rest, **kw))
    monkeypatch.setattr(NB, "CELLS", 2000)
    for got, want in zip(NB.nearest(*asked), whole):
        assert np.array_equal(got, want)
    assert max(held) <= 2000 and sum(held) == 50 * 400


def test_odd_rows(spark):
    rows = vectors(6, 50, d=4)
    same = rows[3][1]
    odd = [(None, same), (60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf"), 0.0, 0.0, 0.0]),
           (64, []), (65, [1.0, 2.0])]
    assert by_id(NB.knn_join(frame(spark, rows + odd), 4)) == {i: v[0] for i, v in brute(rows, 4, "cosine").items()}
    twins = rows + [(3, same), (70, [0.0] * 4)]
    found = NB.knn_join(frame(spark, twins), 3)
    assert found.count() == 3 * len(twins)
    assert [r.neighbour_id for r in found.where("id = 3 and rank = 1").collect()] == [3, 3]
    assert NB.knn_join(frame(spark, []), 3).collect() == []
    assert NB.knn_join(frame(spark, rows[:1]), 3).collect() == []
    assert by_id(NB.knn_join(frame(spark, rows[:3]), 9)) == {i: v[0] for i, v in brute(rows[:3], 9, "cosine").items()}


# --- components --------------------------------------------------------------------------

def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 299)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)]
    random.Random(1).shuffle(links)
    nodes = spark.createDataFrame([(i,) for i in [*range(300), *range(1000, 1201), 5000, 7]], "id long")
    got = CP.connected_components(nodes, spark.createDataFrame(links, "src long, dst long")).distinct().collect()
    assert {r.id: r.component for r in got} == ({i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1201)} | {5000: 5000})


# --- density clusters --------------------------------------------------------------------

def groups_of(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for u, v, _ in edges:
        at[find(u)] = find(v)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return list(out.values())


def top_down(nodes, edges, min_size):
    """Chosen clusters by removing edges from the longest down."""
    def below(members, born):
        """Stability, rows' levels and child clusters of the cluster that is ``members`` at ``born``."""
        stability, levels, here = 0.0, {}, set(members)
        while True:
            inside = [e for e in edges if e[0] in here and e[1] in here]
            # the longest edge that the group needs to hold together
            w = min(t for t in {e[2] for e in inside} if len(groups_of(here, [e for e in inside if e[2] <= t])) == 1)
            parts = groups_of(here, [e for e in inside if e[2] < w])
            big = [p for p in parts if len(p) >= min_size]
            at = 1 / max(w, DN.SHORTEST)
            gone = here - big[0] if len(big) == 1 else here
            stability += len(gone) * (at - born)
            if len(big) != 1:
                return stability, [below(p, at) for p in big], frozenset(members)
            here = big[0]

    def pick(cluster, may=True):
        stability, kids, members = cluster
        best = [pick(k) for k in kids]
        total = sum(b for b, _ in best)
        if may and (not kids or stability >= total - 1e-12):
            return stability, [members]
        return total, [m for _, ms in best for m in ms]
    tops = [below(g, 0.0) for g in groups_of(nodes, edges) if len(g) >= min_size]
    return {m for t in tops for m in pick(t, len(tops) > 1)[1]}


def chosen_clusters(spark, nodes, edges, min_size):
    frame_ = spark.createDataFrame([(n,) for n in nodes], "row long")
    clusters, rows, rounded = DN.condense(frame_, spark.createDataFrame(edges, "u long, v long, w double"), min_size)
    found = rows.join(DN.choose(clusters), "cluster").where("chosen is not null").collect()
    assert len({r.row for r in found}) == len(found)
    out = {}
    for r in found:
        out.setdefault(r.chosen, set()).add(r.row)
    return {frozenset(v) for v in out.values()}, rounded


def random_graph(seed, n, parts):
    rng = random.Random(seed)
    spots = [(rng.random() * parts, rng.random() * parts) for _ in range(parts)]
    xy = [(sx + rng.gauss(0, 0.1 * (1 + p % 3)), sy + rng.gauss(0, 0.1 * (1 + p % 3))) for p in range(parts)
          for sx, sy in [spots[p]] for _ in range(n // parts)]
    edges = set()
    for i, a in enumerate(xy):
        near = sorted((round(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, 2), j) for j, b in enumerate(xy) if j != i)[:6]
        edges |= {(min(i, j), max(i, j), d) for d, j in near}
    return list(range(len(xy))), sorted(edges)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_top_down(spark, seed):
    nodes, edges = random_graph(seed, 90, 5)
    for min_size in (3, 8):
        assert chosen_clusters(spark, nodes, edges, min_size)[0] == top_down(nodes, edges, min_size)


@pytest.mark.parametrize("seed", [4, 5])
def test_contracted_steps_equal_top_down_on_rounded_weights(spark, monkeypatch, seed):
    monkeypatch.setattr(DN, "LOCAL", 40)
    nodes, edges = random_graph(seed, 80, 4)
    got, rounded = chosen_clusters(spark, nodes, edges, 4)
    assert len(rounded) > 2

    def up(w):
        return next((r for r in rounded if w <= r), w)
    assert got == top_down(nodes, [(u, v, up(w)) for u, v, w in edges], 4)


def test_groups_of_unlike_density_are_found(spark):
    """A tight group, a wide one and stray rows: one cell width or radius fits not both."""
    rng = np.random.default_rng(8)
    tight = rng.normal(size=(60, 2)) * 0.02
    wide = rng.normal(size=(60, 2)) * 1.0 + [12, 0]
    stray = rng.uniform(-60, 60, size=(8, 2))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.vstack([tight, wide, stray]))]
    v = NB.prepare(frame(spark, rows), metric="euclidean")
    found = DN.density_clusters(NB.neighbour_graph(v, 15), v.rows.select("row"), 15, 5)
    got = {r.id: (r.cluster, r.probability) for r in v.rows.join(found, "row").collect()}
    first, second = ({got[i][0] for i in part} - {None} for part in (range(60), range(60, 120)))
    assert len(first) == 1 and len(second) == 1 and first != second
    assert sum(got[i][0] is not None for i in range(120)) >= 110
    assert all(0 <= p <= 1 for _, p in got.values())


def test_no_edges_is_all_noise(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "row long")
    empty = spark.createDataFrame([], "row long, other long, d double, rank int")
    assert [(r.cluster, r.probability) for r in DN.density_clusters(empty, nodes).collect()] == [(None, 0.0)] * 2
