"""Edge cases on small in-memory inputs, checked against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from agrisentinel.functions import text as T
from agrisentinel.operators import cluster as CL
from agrisentinel.operators import common as CM
from agrisentinel.operators import evaluate as V
from agrisentinel.operators import ingest as I
from agrisentinel.operators import profile as P
from agrisentinel.operators import shape as S
from agrisentinel.operators import summarise as SU
from agrisentinel.sources import files as FS


def test_keep_first_across_batches(spark):
    rows = [("a", 1, 0), ("b", 0, 3), ("a", 0, 5), ("", 0, 0), (None, 0, 1), ("b", 0, 2),
            ("c", 2, 0), ("a", 0, 4)]
    df = spark.createDataFrame(rows, "url string, batch_seq int, pos int")
    got = {r.url: (r.batch_seq, r.pos) for r in I.keep_first(df, "url", ["batch_seq", "pos"]).collect()}
    assert got == {"a": (0, 4), "b": (0, 2), "c": (2, 0)}


def test_new_unique_excludes_seen(spark):
    batch = spark.createDataFrame([("x", 0, 0), ("y", 0, 1), ("x", 0, 2)], "url string, b int, p int")
    seen = spark.createDataFrame([("y",)], "url string")
    assert [r.url for r in I.new_unique(batch, seen, "url", ["b", "p"]).collect()] == ["x"]


def test_paginate_stops_at_first_empty_page(spark):
    rows = [(1, 1, 3), (1, 2, 0), (1, 3, 4), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1),
            (2, 5, 1), (2, 6, 1)]
    df = spark.createDataFrame(rows, "session long, page_num long, n_links int")
    got = sorted((r.session, r.page_num) for r in I.paginate_until_empty(df, limit=5).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]


def test_chunks_at_and_over_size(spark):
    texts = [("a b c d", 1), ("a b c d e", 2), ("   ", 3), ("x", 4)]
    df = spark.createDataFrame(texts, "text string, doc_id int")
    got = {r.doc_id: r.c for r in df.select("doc_id", SU.chunks("text", 4).alias("c")).collect()}
    assert got[1] == ["a b c d"]
    assert got[2] == ["a b c d", "e"]
    assert got[3] == ["   "]
    assert got[4] == ["x"]


def test_marker_extraction(spark):
    df = spark.createDataFrame([("no marker here ",), ("x Summary: one ",), ("a Summary: b Summary: c",)],
                               "g string")
    got = [r.s for r in df.select(T.after_marker("g").alias("s")).collect()]
    assert got == ["no marker here", "one", "c"]


def test_histogram_max_in_last_bin_and_constant_column(spark):
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 5.0), (10.0, 5.0), (9.99, 5.0), (None, 5.0)],
                               "x double, y double")
    h = {(r.col_name, r.bin): r["count"] for r in P.histogram(df, ["x", "y"], 10).collect()}
    assert h[("x", 9)] == 2 and h[("x", 0)] == 1 and h[("x", 5)] == 1
    assert h[("y", 0)] == 5


def test_describe_quartiles_like_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    r = P.describe(df, ["x"]).collect()[0]
    assert (r.q25, r.q50, r.q75) == (1.5, 2.0, 3.0)
    assert r["count"] == 3 and math.isclose(r.std, np.std([1, 2, 4], ddof=1))


def test_exact_quantiles_random(spark):
    rnd = random.Random(1)
    vals = [rnd.randint(0, 50) * 1.0 for _ in range(500)]
    df = spark.createDataFrame([("k", v) for v in vals], "key string, value double")
    q = {r.p: r.q for r in CM.exact_quantiles(df, "key", "value", [0.1, 0.5, 0.9], ranges=7).collect()}
    for p in (0.1, 0.5, 0.9):
        assert math.isclose(q[p], float(np.quantile(vals, p)))


def test_running_totals_and_top_k(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, rnd.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): r.v_cum for r in CM.running_totals(df, ["g"], ["o"], ["v"], ranges=5).collect()}
    acc = {}
    for g, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        acc[g] = acc.get(g, 0) + v
        assert got[(g, o)] == acc[g]
    top = CM.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("o")], 3, salt_buckets=4).collect()
    for g in "ab":
        want = sorted([r for r in rows if r[0] == g], key=lambda x: (-x[2], x[1]))[:3]
        assert [(r.o, r.rank) for r in sorted((t for t in top if t.g == g), key=lambda t: t.rank)] == \
            [(w[1], i + 1) for i, w in enumerate(want)]


def test_auc_with_ties_matches_pair_count(spark):
    rows = [(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1), (0.0, 0.9), (1.0, 0.3)]
    df = spark.createDataFrame(rows, "label double, score double")
    auc = V.roc_auc(df).collect()[0].auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, want)


def test_confusion_has_zero_cells(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    cells = {(r.label, r.prediction): r["count"] for r in V.confusion_long(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "exceeding_loq int")
    w = {r.exceeding_loq: r.weight for r in S.balanced_weights(df).collect()}
    assert math.isclose(w[0], 8 / (2 * 6)) and math.isclose(w[1], 8 / (2 * 2))


def test_rss_missing_date(spark):
    xml = ("<rss><channel><item><link>http://a</link><pubDate>Mon, 09 Jun 2025 10:00:00 GMT"
           "</pubDate></item><item><link>http://b</link></item><item><title>x</title></item>"
           "</channel></rss>")
    df = spark.createDataFrame([(xml,)], "xml string")
    got = sorted((r.url, r.date) for r in FS.parse_rss(df).collect())
    assert got == [("http://a", "Mon, 09 Jun 2025 10:00:00 GMT"), ("http://b", "No date available")]
    ts = df.select(T.parse_rss_date(F.lit("Mon, 09 Jun 2025 10:00:00 GMT")).alias("t")).collect()[0].t
    assert ts is not None


def test_grid_clusters_recover_blobs(spark):
    rnd = np.random.default_rng(0)
    pts = []
    for i, c in enumerate([(0.0, 0.0), (10.0, 10.0)]):
        for j in range(10):
            pts.append((i * 100 + j, [float(x) for x in np.array(c) + rnd.normal(0, 0.05, 2)]))
    pts.append((500, [5.0, -7.0]))
    pts.append((501, [20.0, -20.0]))
    pts.append((502, [20.05, -20.05]))
    df = spark.createDataFrame(pts, "id long, coords array<double>")
    got = {r.id: r.cluster for r in CL.grid_density_clusters(df, width=0.5).collect()}
    a = {got[i] for i in range(10)}
    b = {got[100 + i] for i in range(10)}
    assert len(a) == 1 and len(b) == 1 and a != b and -1 not in a | b
    assert got[500] == -1 and got[501] == -1 and got[502] == -1


def test_single_linkage_is_kruskal(spark):
    rnd = random.Random(3)
    pts = {i: (rnd.random(), rnd.random()) for i in range(7)}
    pairs = [(a, b, math.dist(pts[a], pts[b])) for a in pts for b in pts if a < b]
    df = spark.createDataFrame(pairs, "topic_a long, topic_b long, distance double")
    got = [(r.left, r.right) for r in CL.single_linkage(df).orderBy("step").collect()]
    parent = list(range(7))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    want = []
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.append((a, b))
    assert got == want


def test_html_parsed_and_regex_agree_on_clean_html(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav>"
            "<main><p>Hello <b>world</b> &amp; more</p></main><footer>f</footer></body></html>")
    from agrisentinel.functions import html as H
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(H.html_text_regex("html").alias("a"), H.html_text_parsed("html").alias("b")).collect()[0]
    assert r.a == r.b == "Hello world & more"


def test_one_hot_unseen_and_null_categories(spark):
    from pyspark.ml.functions import vector_to_array
    from agrisentinel.operators import classify as C
    train = spark.createDataFrame([("a", 1.0, 0.0), ("b", None, 1.0), (None, 2.0, 0.0)],
                                  "origin string, x double, label double")
    test = spark.createDataFrame([("zz", float("nan"), 1.0)], "origin string, x double, label double")
    cats, nums = C.feature_columns(train, ["label"])
    enc = C.encoder(cats, nums).fit(C.prepare(train, cats, nums))
    tr = {r.origin: r.f for r in enc.transform(C.prepare(train, cats, nums))
          .select("origin", vector_to_array("features").alias("f")).collect()}
    te = enc.transform(C.prepare(test, cats, nums)).select(
        vector_to_array("features").alias("f")).collect()[0].f
    # three levels seen in training (null is its own level) keep one slot each;
    # the indexer's unseen bucket is the dropped last slot, so unseen → all zeros
    assert len(te) == 4 and te[:3] == [0.0, 0.0, 0.0] and te[3] == C.MISSING
    assert tr[C.NULL_LEVEL][:3] != [0.0, 0.0, 0.0]
    assert tr["b"][3] == C.MISSING
