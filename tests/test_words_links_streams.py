"""Trained word vectors, links by container and keyed-state keep-first."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrisentinel.functions import html as H
from agrisentinel.operators import words as W
from agrisentinel.session import scratch_path
from agrisentinel.streaming import jobs as J

# --- word vectors ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Two themes whose words never meet, a text without words, a null and a repeated id."""
    rng = random.Random(3)
    sea, land = [f"sea{c}" for c in "abcdefghij"], [f"land{c}" for c in "abcdefghij"]
    rows = [(i, " ".join(rng.choice(sea if i % 2 else land) for _ in range(40)), "x") for i in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (None, " ".join(sea), "x"), (902, "zzz qqq", "x"), (0, " ".join(land), "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string")


@pytest.fixture(scope="module")
def trained(corpus):
    tokens = W.token_table(corpus)
    return tokens, W.train(tokens, size=16, rounds=3)


def test_a_rerun_in_one_partition_gives_the_same_vectors(corpus, trained):
    first = W.train(trained[0], size=16, partitions=1)
    again = W.train(W.token_table(corpus.repartition(3)), size=16, partitions=1)
    assert again.words == first.words and np.array_equal(again.vectors, first.vectors)


def test_words_of_one_theme_are_near(trained):
    m = trained[1]
    s = m.vectors @ m.vectors.T
    theme = np.array([w.startswith("sea") for w in m.words])
    same = s[theme[:, None] == theme[None, :]].mean()
    assert len(m.words) == 20 and same > s[theme[:, None] != theme[None, :]].mean() + 0.2


def test_the_vocabulary_is_bounded_without_splitting_ties(spark):
    tokens = spark.createDataFrame([(1, ["a"] * 9 + ["b"] * 7 + ["c"] * 7 + ["d"] * 5)], "doc_id long, tokens array<string>")
    assert W.train(tokens, size=4, vocabulary=4).words == ["a", "b", "c", "d"]
    assert W.train(tokens, size=4, vocabulary=2).words == ["a"]
    assert W.train(tokens, size=4, min_count=50).words == []


def test_document_vectors_and_keyphrases_equal_brute_force(trained):
    tokens, m = trained
    docs = {(r.doc_id, tuple(r.tokens)) for r in tokens.collect()}
    want_vec, want_top = [], []
    for i, toks in docs:
        at = [m.words.index(t) for t in toks if t in m.words]
        mean = m.vectors[at].mean(axis=0) if at else None
        want_vec.append((i, len(at), None if mean is None else np.round(mean / np.linalg.norm(mean), 8).tolist()))
        if at:
            cos = {m.words[j]: round(float(m.vectors[j] @ mean / np.linalg.norm(mean)), 10) for j in set(at)}
            want_top += [(i, r, w) for r, (w, _) in enumerate(sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    got = [(r.doc_id, r.n_known, None if r.vector is None else np.round(r.vector, 8).tolist())
           for r in W.document_vectors(tokens, m).collect()]
    assert sorted(got, key=repr) == sorted(want_vec, key=repr)
    top = [(r.doc_id, r["rank"], r.term) for r in W.keyphrases(tokens, m).collect()]
    assert sorted(top, key=repr) == sorted(want_top, key=repr)


def test_topic_words_equal_brute_force(spark, trained):
    tokens, m = trained
    reps = tokens.where("doc_id < 40").select((F.col("doc_id") % 2).alias("topic"), "tokens")
    cand = spark.createDataFrame([(t, w) for t in (0, 1) for w in ("seaa", "seab", "landa", "landb", "seac landc", "nowhere")],
                                 "topic long, term string")
    got = {(r.topic, r["rank"], r.term) for r in W.topic_words(cand, reps, m, 4).collect()}
    want = set()
    for t in (0, 1):
        centre = np.mean([m.mean(r.tokens) for r in reps.where(F.col("topic") == t).collect()], axis=0)
        cos = {w: round(float(m.mean(w.split()) @ centre / np.linalg.norm(centre)), 10)
               for w in ("seaa", "seab", "landa", "landb", "seac landc")}
        want |= {(t, r, w) for r, (w, _) in enumerate(sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:4], 1)}
    assert got == want


def test_no_documents(spark):
    tokens = W.token_table(spark.createDataFrame([], "doc_id long, text string"))
    m = W.train(tokens)
    assert m.words == [] and W.document_vectors(tokens, m).collect() == [] and W.keyphrases(tokens, m).collect() == []


# --- links by container ------------------------------------------------------------------

@pytest.mark.parametrize("html, selector, want", [
    ('<div class="big x"><p><a href="/1">1</a><a href="/2">2</a></div><div class="big"><a href="/3">', "div.big", [(0, "/1"), (1, "/3")]),
    ('<div class="big"><div class="big"><a href="/in"></a></div><a href="/out"></a></div>', "div.big", [(0, "/in"), (1, "/in")]),
    ('<div class="big"><div class="big">none</div><a href="/out"></a></div>', "div.big", [(0, "/out")]),
    ('<ul><li><a href="/a">a<li><a href="/b">b</ul><a href="/c">', "li", [(0, "/a"), (1, "/b")]),
    ('<li></span></div><a href="/stray">', "li", [(0, "/stray")]),
    ('<div class="big"><br><img src="x"><a name="n">no link</a><a href>empty</a></div>', "div.big", [(0, "")]),
    ('<div class="bigger"><a href="/no"></a></div><section class="big"><a href="/yes?a=1&amp;b=2"></a></section>', ".big", [(0, "/yes?a=1&b=2")]),
    ('<div class="big"><script>var s = "<a href=\'/script\'>";</script><!-- <a href="/comment"> --></div>', "div.big", []),
    ('<A HREF="/upper"></A>', "a", [(0, "/upper")]),
    ('<div class="big"><a href="/first" href="/second"></a></div>', "div", [(0, "/first")]),
    ("", "div", []), (None, "div", []), ("no tags", "div", []),
])
def test_first_link_of_each_container(html, selector, want):
    if selector == "a":
        want = []   # a link is not inside itself
    assert H.first_links(html, selector) == want


def test_container_links_of_pages(spark):
    deep = "<div>" * 5000 + '<a href="/deep">' + "</div>" * 5000
    rows = [(1, '<div class="b"><a href="/1"></a></div>' * 2, "x"), (2, None, "x"), (2, '<div class="b"><a href="/2"></a>', "x"),
            (None, '<div class="b"><a href="/n"></a>', "x"), (4, "<p>nothing", "x"), (5, deep, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, pos string")
    got = sorted(((r.page_id, r.pos, r.url) for r in H.container_links(pages, "div.b").collect()), key=repr)
    assert got == [(1, 0, "/1"), (1, 1, "/1"), (2, 0, "/2"), (None, 0, "/n")]
    assert H.container_links(pages.where("page_id = 5"), "div").count() == 5000
    assert H.container_links(pages.limit(0), "div").collect() == []


# --- strict keep-first -------------------------------------------------------------------

DAY = dt.datetime(2024, 1, 10)


def land(spark, folder, name, rows):
    """``rows``: (event id, hours after DAY, user)."""
    data = [(i, DAY + dt.timedelta(hours=h), u, "t", 0.0, "{}") for i, h, u in rows]
    spark.createDataFrame(data, J.EVENT_SCHEMA).write.parquet(f"{folder}/{name}")


def test_corrections_across_restarts(spark):
    folder, out, ck = (scratch_path(spark, x) for x in ("k7-in", "k7-out", "k7-ck"))
    arrivals = [[(10, 50, 1), (11, 51, 1), (12, 40, 2), (13, 60, 3)],   # firsts
                [(5, 30, 1), (12, 40, 2), (14, 61, 3)],                 # an earlier record; a repeat; a later one
                [(4, 30, 1), (20, 10, 2), (3, 30, 1), (30, 70, 4)]]     # a tie in time goes to the smaller id
    seen = []
    for i, rows in enumerate(arrivals):
        land(spark, folder, f"f{i}", rows)
        seen += rows
        J.run_earliest(J.event_stream(spark, f"{folder}/*"), out, ck)
        now = {(r.key, r.event_id) for r in J.earliest_now(spark.read.schema(J.CHANGE).parquet(out)).collect()}
        want = {(f"http://u/{u}", min((h, e) for e, h, v in seen if v == u)[1]) for _, _, u in seen}
        assert now == want
    changes = spark.read.schema(J.CHANGE).parquet(out).where("change != 'settled'")
    got = sorted((r.key[-1], r.version, r.event_id, r.change, r.replaces) for r in changes.collect())
    assert got == [("1", 0, 10, "first", None), ("1", 1, 5, "correction", 10), ("1", 2, 3, "correction", 5),
                   ("2", 0, 12, "first", None), ("2", 1, 20, "correction", 12), ("3", 0, 13, "first", None),
                   ("4", 0, 30, "first", None)]


def test_a_record_settles_when_the_watermark_passes_it(spark):
    folder, out, ck = (scratch_path(spark, x) for x in ("k7s-in", "k7s-out", "k7s-ck"))
    for i, rows in enumerate([[(1, 5, 1), (2, 6, 2)], [(3, 30, 3)], [(4, 1, 1), (5, 31, 2)]]):
        land(spark, folder, f"f{i}", rows)
        J.run_earliest(J.event_stream(spark, f"{folder}/*"), out, ck, delay="2 hours")
    changes = spark.read.schema(J.CHANGE).parquet(out).collect()
    settled = {(r.key, r.event_id) for r in changes if r.change == "settled"}
    assert {("http://u/1", 1), ("http://u/2", 2)} <= settled
    # event 4 is earlier, but later than the watermark allows
    assert {(r.key, r.event_id) for r in changes if r.change != "settled"} == {
        ("http://u/1", 1), ("http://u/2", 2), ("http://u/3", 3)}
