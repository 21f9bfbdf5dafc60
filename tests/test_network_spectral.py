"""Co-occurrence network, spectral reduction, leaf order, topic assignment, counters, kernel features."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from agrisentinel.operators import classify as C
from agrisentinel.operators import counters as CN
from agrisentinel.operators import embed as EM
from agrisentinel.operators import neighbours as NB
from agrisentinel.operators import network as NW
from agrisentinel.operators import spectral as SP
from agrisentinel.operators import topics as TP
from agrisentinel.session import scratch_path, store


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string, w long")


def random_edges(seed, n=30, m=90, hub=False):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    if hub:
        pairs |= {(i, 99) for i in range(n)}
    return [(f"t{a:02d}", f"t{b:02d}", rng.randint(1, 9)) for a, b in sorted(pairs)]


@pytest.mark.parametrize("hub", [False, True])
def test_ranks_equal_the_linear_system(spark, hub):
    edges = random_edges(1, hub=hub)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w
    walk = m / m.sum(axis=0)
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * walk, np.full(len(names), 0.15 / len(names)))
    got = {r.term: r["rank"] for r in NW.ranks(edge_frame(spark, edges)).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-6) and abs(sum(got.values()) - 1) < 1e-5
    assert NW.ranks(edge_frame(spark, [("a", "a", 3), ("b", "c", 0), (None, "c", 2)])).collect() == []


def test_rounds_of_ranks_read_numbers_not_terms(spark, monkeypatch):
    kept = {}
    keep = NW.store
    monkeypatch.setattr(NW, "store", lambda df, name: kept.setdefault(name, df) and keep(df, name))
    got = {r.term: r["rank"] for r in NW.ranks(edge_frame(spark, [("a", "b", 2), ("b", "c", 1)])).collect()}
    assert set(got) == {"a", "b", "c"} and abs(sum(got.values()) - 1) < 1e-6
    assert "string" not in dict(kept["network-walk"].dtypes).values()
    assert "string" not in dict(kept["network-ranks"].dtypes).values()


def test_communities_equal_brute_force(spark):
    edges = random_edges(2, n=60, m=160, hub=True)
    s = {}
    for a, b, w in edges:
        for x in (a, b):
            s[x] = s.get(x, 0) + w
    total = sum(s.values())
    near = {x: [] for x in s}
    for a, b, w in edges:
        lift = round(w * total / (s[a] * s[b]), 9)
        if lift > 1:
            near[a].append((-lift, b))
            near[b].append((-lift, a))
    top = {x: {y for _, y in sorted(v)[:3]} for x, v in near.items()}
    group = {x: x for x in s}
    for _ in s:
        for x in s:
            for y in top[x]:
                if x in top[y]:
                    group[x] = group[y] = min(group[x], group[y])
    got = {r.term: r.community for r in NW.communities(edge_frame(spark, edges), strongest=3).collect()}
    assert got == group and len(set(got.values())) > 1


# --- spectral reduction ------------------------------------------------------------------

def preserved(spark, v, coords, k):
    points = NB.prepare(coords.select(F.col("row").alias("id"), "coords"), "id", "coords", "euclidean")
    near = NB.neighbour_graph(points, k)
    ids = points.rows.select("row", "id")
    named = near.join(ids, "row").select(F.col("id").alias("row"), F.col("other_id").alias("other"))
    return SP.preservation(NB.neighbour_graph(v, k), named).first().preserved


def test_neighbours_are_kept_better_than_by_projection(spark):
    """A closed line whose widest plane it rounds five times: points far apart along the line meet there."""
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    x = np.stack([size * f(m * t) for m, size in ((1, 0.3), (5, 1.1), (7, 1.0)) for f in (np.sin, np.cos)], axis=1)
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, embedding array<double>")
    v = NB.prepare(rows, metric="euclidean")
    spectral = SP.spectral_coordinates(NB.neighbour_graph(v, 6), v.rows, 2, tolerance=1e-5)
    pca = EM.pca_project(v.rows.select("row", "vec"), "vec", 2, normalise=False)
    ours, theirs = (preserved(spark, v, c.select("row", "coords"), 6) for c in (spectral, pca))
    assert ours > theirs + 0.1


def test_coordinates_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted((i, (i + int(j)) % 40))) for i in range(40) for j in rng.integers(1, 5, 3)}
    graph = spark.createDataFrame(sorted(pairs), "row long, other long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "row long")
    got = {r.row: r.coords for r in SP.spectral_coordinates(graph, nodes, 3, tolerance=1e-8).collect()}
    m = np.zeros((40, 40))
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    d = m.sum(axis=1)
    values, vectors = np.linalg.eigh(m / np.sqrt(np.outer(d, d)))
    want = (vectors / np.sqrt(d)[:, None] * np.sqrt(d.sum()))[:, ::-1][:, 1:4]
    ours = np.array([got[i] for i in range(40)])
    assert got[40] == [0.0, 0.0, 0.0]
    # up to sign, or to rotation where eigenvalues are near: the spanned space is compared
    q, _ = np.linalg.qr(want * np.sqrt(d)[:, None])
    ours = ours * np.sqrt(d)[:, None]
    assert np.linalg.norm(ours - q @ (q.T @ ours)) < 0.05 * np.linalg.norm(ours)
    assert SP.spectral_coordinates(graph.limit(0), nodes, 2).first().coords == [0.0, 0.0]


# --- topics ------------------------------------------------------------------------------

def test_assignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(NB, "SLICE", 3)     # centroids in several blocks
    monkeypatch.setattr(TP, "ASSIGN_CHUNK", 20)
    rng = np.random.default_rng(5)
    cent, docs = rng.normal(size=(8, 5)), rng.normal(size=(100, 5))
    cent[7] = cent[2]   # a tie
    c = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in enumerate(cent)], "topic int, centroid array<double>")
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(docs)] + [(200, None, "x"), (201, [1.0], "x"), (0, [0.0] * 5, "x")]
    d = spark.createDataFrame(rows, "doc_id long, embedding array<double>, topic string")
    got = sorted(((r.doc_id, r.topic, r.runner_up, round(r.similarity, 8)) for r in TP.assign_to_topics(d, c).collect()), key=repr)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    cos = unit(np.vstack([docs, np.zeros((1, 5))])) @ unit(cent).T
    want = []
    for i, s in zip([*range(100), 0], cos):
        first, second = sorted((-round(float(x), 10), t) for t, x in enumerate(s))[:2]
        want.append((i, first[1], second[1], round(-first[0], 8)))
    fair = [w for w in want if w[3] != 0.0]     # the zero vector is as far from every topic
    assert [g for g in got if g[3] not in (0.0, 0.5)] == sorted(fair, key=repr)
    single = TP.assign_to_topics(d, c.where("topic = 1")).first()
    assert single.topic == 1 and single.runner_up is None and single.margin is None
    assert TP.assign_to_topics(d.limit(0), c).collect() == []


def test_leaves_of_the_merge_tree_lie_side_by_side(spark):
    topics = spark.createDataFrame([(t,) for t in (5, 3, 8, 1, 9)], "topic int")
    merges = spark.createDataFrame([(0, 8, 9, 0.1), (1, 1, 5, 0.2), (2, 5, 9, 0.3)], "step long, left long, right long, distance double")
    got = {r.topic: r.position for r in TP.leaf_order(merges, topics).collect()}
    assert sorted(got, key=got.get) == [1, 5, 8, 9, 3]
    assert [r.position for r in TP.leaf_order(merges.limit(0), topics).orderBy("topic").collect()] == [0, 1, 2, 3, 4]


# --- counters ----------------------------------------------------------------------------

def test_sketches_add_up_within_their_bound(spark):
    rng = random.Random(6)
    rows = [(d, rng.randrange(20_000)) for d in range(6) for _ in range(9000)] + [(0, None)]
    frame = spark.createDataFrame(rows, "day int, user long")
    daily = store(CN.daily_sketches(frame, F.col("day"), "user"), "test-sketches")
    whole = CN.merged_counts(daily).first()
    exact = len({u for _, u in rows} - {None})
    assert whole.n == len(rows) and abs(whole.estimate - exact) <= CN.error_bound() * exact
    for r in CN.merged_counts(daily, F.col("day")).collect():
        true = len({u for d, u in rows if d == r.day} - {None})
        assert abs(r.estimate - true) <= CN.error_bound() * true


def test_a_write_is_observed(spark):
    path = scratch_path(spark, "test-observed")
    seen = CN.observed_write(spark.range(10), path, n=F.count(F.lit(1)), top=F.max("id"))
    assert (seen["n"], seen["top"]) == (10, 9) and spark.read.parquet(path).count() == 10


# --- kernel features ---------------------------------------------------------------------

def test_kernel_features_separate_rings(spark):
    rng = np.random.default_rng(7)
    turn, far = rng.uniform(0, 2 * np.pi, 300), np.repeat([1.0, 3.0], 150) + rng.normal(size=300) * 0.15
    rows = [(i, float(far[i] > 2), float(far[i] * np.cos(turn[i])), float(far[i] * np.sin(turn[i]))) for i in range(300)]
    frame = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, label double, x double, y double"))
    accuracy = {}
    (mapped,), (again,) = C.fourier_features(frame, dims=100), C.fourier_features(frame, dims=100)
    for name, data, column in (("linear", frame, "features"), ("kernel", store(mapped, "test-kernel"), "kernel_features")):
        fit = C.LinearSVC(featuresCol=column, labelCol="label", maxIter=50).fit(data)
        accuracy[name] = fit.transform(data).where("prediction = label").count() / 300
    assert accuracy["kernel"] > 0.97 and accuracy["linear"] < 0.8
    assert mapped.orderBy("id").select("kernel_features").collect() == again.orderBy("id").select("kernel_features").collect()
    # inner products come near the kernel
    z = np.array([r.kernel_features.toArray() for r in C.fourier_features(frame, dims=4000, gamma=0.5)[0].orderBy("id").limit(20).collect()])
    p = np.array([r[2:] for r in rows[:20]])
    kernel = np.exp(-0.5 * ((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.12
    null = frame.select("id", F.when(F.col("id") > 0, F.col("features")).alias("features"))
    assert [r.id for r in C.fourier_features(null, dims=8)[0].where("kernel_features is null").collect()] == [0]
    assert C.fourier_features(frame.limit(0))[0].collect() == []
    assert list(itertools.islice(mapped.columns, 4)) == ["id", "label", "x", "y"]
