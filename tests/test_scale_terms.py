"""What the term and pair operators shuffle and leave behind, against plain counting."""

import collections
import glob
import math
import random
import re

from pyspark.sql import functions as F

from agrisentinel.llm import op10_ngram_join as J
from agrisentinel.operators import summarise as SU
from agrisentinel.operators import terms as TM
from agrisentinel.operators import topics as TP
from agrisentinel.operators import words as W
from agrisentinel.plans.q_topics import _bin_counts
from agrisentinel.session import checkpoint_root


def test_vocabulary_counts_ids_once(spark, monkeypatch):
    texts = [(1, "red fox red fox"), (2, "red fox jumps"), (3, "blue whale"), (3, "blue fox"), (3, "blue whale"),
             (None, "lonely whale"), (None, "lonely fox"), (4, None), (5, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = collections.Counter()
    for i in {t[0] for t in texts}:
        held = set()
        for t in (t.split() for j, t in texts if j == i and t):
            held |= set(t) | {" ".join(p) for p in zip(t, t[1:])}
        want.update(held)
    want = {t: n for t, n in want.items() if n >= 2}
    for limit in (TM.BROADCAST_IDS, 0):     # repeated ids met by shuffle, too
        monkeypatch.setattr(TM, "BROADCAST_IDS", limit)
        assert {r.term: r["df"] for r in TM.vocabulary(d).collect()} == want
    unique = d.where("doc_id < 3")
    plan = TM.vocabulary(unique)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
    assert {r.term: r["df"] for r in TM.vocabulary(unique).collect()} == {"red": 2, "fox": 2, "red fox": 2}


def test_keyphrases_count_in_place(spark, monkeypatch):
    rng = random.Random(7)
    texts = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 60}x" for _ in range(rng.randint(0, 25)))) for i in range(40)]
    texts += [(50, "aa bb aa"), (50, "aa cc"), (51, None), (52, ""), (None, "aa dd"), (None, "dd ee t1x"), (53, "solo")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    tf = collections.defaultdict(collections.Counter)
    for i, t in texts:
        tf[i].update((t or "").split())
    df = collections.Counter(w for c in tf.values() for w in c)
    best = {i: sorted((-math.floor(n * math.log(len(texts) / df[w]) * 1e8 + 0.5), w) for w, n in c.items())[:5] for i, c in tf.items()}
    want = {i: "; ".join(w for _, w in b) for i, b in best.items() if b}
    for common in (TM.COMMON_TERMS, 3):     # most frequencies sent to the tasks, or met by shuffle
        monkeypatch.setattr(TM, "COMMON_TERMS", common)
        assert {r.doc_id: r.keyphrases for r in TM.keyphrases_tfidf(d).collect()} == want
    plan = TM.keyphrases_tfidf(d.where("doc_id < 50"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, (term|_salt)", plan)
    assert "WindowGroupLimit" in plan


def test_summaries_move_texts_once(spark):
    rng = random.Random(5)
    names = [f"word{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    texts = [(i, ". ".join(say(rng.randint(1, 6)) for _ in range(12)) + ".") for i in range(30)]
    texts += [(40, "  "), (41, None), (42, "..."), (43, "the and. of the."), (None, "word1 word2. word3."),
              (50, "word1. word2 word3. word4."), (50, "word5 word6. word7."), (51, "a  b\tc")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    held = [set(re.findall(r"word\d+", t or "")) for _, t in texts]
    idf = {w: math.log(len(texts) / sum(w in h for h in held)) for w in set().union(*held)}
    want, per_text = {}, {}
    for i, t in texts:
        if t and t.strip(" ") and i is not None:
            tok = t.strip(" ").split()
            for c, piece in enumerate([t] if len(tok) <= 20 else [" ".join(tok[at: at + 20]) for at in range(0, len(tok), 20)]):
                for n, x in enumerate(re.findall(r"[^.!?]+[.!?]*", piece)):
                    per_text.setdefault(i, {}).setdefault(c, []).append((n, x.strip(" ")))
    for i, pieces in per_text.items():
        said = []
        for c in sorted(pieces):
            by = {}     # sentences of one id, chunk and place share a score
            for n, x in pieces[c]:
                by.setdefault(n, []).extend(idf[w] for w in re.findall(r"word\d+", x))
            best = sorted((-round(sum(by[n]) / len(by[n]), 8) if by[n] else 0.0, n, x) for n, x in pieces[c])[:3]
            said.append(" ".join(x for _, n, x in sorted(best, key=lambda b: b[1:])))
        want[i] = " ".join(said)
    found = SU.extractive_summaries(d, max_tokens=20, max_sentences=3)
    got = collections.Counter((r.doc_id, r.summary) for r in found.collect())
    assert got == collections.Counter((i, want.get(i, "")) for i, _ in texts)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    chunks = collections.Counter(r.doc_id for r in SU.chunk_rows(d, max_tokens=20).collect())
    counted = d.groupBy("doc_id").agg(F.sum(SU.chunk_count("text", 20)).alias("n")).collect()
    assert {r.doc_id: r.n for r in counted if r.n} == chunks


def test_near_duplicates_release_what_is_read_no_more(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:30] + [f"x{i}"] + base[31:])) for i in range(6)] + [(9, "something else entirely here now")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    at = f"{checkpoint_root(spark).removeprefix('file:')}/agrisentinel/op10-"
    before = set(glob.glob(at + "*"))
    found = J.similarity_classes(d, num=80)
    assert {r.id: r.component_id for r in found.collect()} == {**{i: 0 for i in range(6)}, 9: 9}
    left = {g.removeprefix(at).rsplit("-", 1)[0] for g in set(glob.glob(at + "*")) - before}
    assert not left & {"scan", "shared", "spares", "rare", "ids", "sets", "features", "common"}


def test_training_uses_the_cores(spark, monkeypatch):
    d = spark.createDataFrame([(i, ["red", "fox", "blue", "whale"]) for i in range(40)], "doc_id long, tokens array<string>")
    asked = []
    word2vec = W.Word2Vec
    monkeypatch.setattr(W, "Word2Vec", lambda **k: asked.append(k["numPartitions"]) or word2vec(**k))
    monkeypatch.setattr(W, "LEAST_PARTITIONS", 7)
    assert W.train(d, size=4).words == ["blue", "fox", "red", "whale"]
    monkeypatch.setattr(W, "LEAST_PARTITIONS", 1)
    W.train(d, size=4)
    assert asked == [7, spark.sparkContext.defaultParallelism]


def test_pairs_are_counted_by_code_in_their_task(spark, monkeypatch):
    rng = random.Random(11)
    texts = [(i % 30, " ".join(f"t{int(rng.paretovariate(0.8)) % 40}x" for _ in range(rng.randint(0, 30)))) for i in range(45)]
    texts += [(50, None), (51, ""), (52, "solo"), (53, "t1x t1x t1x"), (None, "t2x the t3x"), (54, "zz t1x once")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [[w for w in (t or "").split() if w != "the"] for _, t in texts]
    df = collections.Counter(w for r in rows for w in set(r))
    want = collections.Counter(p for r in rows for p in {
        tuple(sorted((x, y))) for i, x in enumerate(r) for y in r[i + 1: i + 4] if x != y and min(df[x], df[y]) >= 2})
    found = TM.cooccurrence(d, window=3)
    assert found.dtypes == [("term_a", "string"), ("term_b", "string"), ("n_docs", "bigint")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(a#\d+L, b#\d+L", plan)
    assert {(r.term_a, r.term_b): r.n_docs for r in found.collect()} == want
    # slices of few tokens; a first seed under which terms share a code
    monkeypatch.setattr(TM, "SLICE", 20)
    code, seeds = TM._code, set()
    monkeypatch.setattr(TM, "_code", lambda t, seed: seeds.add(seed) or (
        F.length(t).cast("long") if seed == 0 else code(t, seed)))
    got = TM.cooccurrence(d, window=3).collect()
    assert len(got) == len(want) and {(r.term_a, r.term_b): r.n_docs for r in got} == want and seeds == {0, 1}


def test_vector_keyphrases_meet_vectors_where_documents_are(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(f"t{int(rng.paretovariate(0.8)) % 30}x" for _ in range(rng.randint(0, 12)))) for i in range(25)]
    texts += [(30, "t1x t2x alone"), (30, "t1x mixed"), (31, None), (32, "the"), (33, "single")]
    rows = [(i, t, [rng.choice([-1.0, 0.5, 2.0]) + rng.randint(1, 9) / 8 for _ in range(3)]) for i, t in texts]
    d = spark.createDataFrame(rows, "doc_id long, text string, embedding array<float>")
    met = [(i, w, y) for i, t, _ in rows for w in sorted(set((t or "").split()) - {"the"}) for j, _, y in rows if j == i]
    held = collections.defaultdict(list)
    for _, w, y in met:
        held[w].append(y)
    mean = {w: [sum(c) / len(v) for c in zip(*v)] for w, v in held.items()}
    size = lambda v: math.sqrt(sum(c * c for c in v))
    best = collections.defaultdict(list)
    for i, w, y in met:
        best[i].append((-math.floor(sum(a * b for a, b in zip(mean[w], y)) / (size(mean[w]) * size(y)) * 1e8 + 0.5), w))
    want = {i: "; ".join(w for _, w in sorted(b)[:5]) for i, b in best.items()}
    for common in (TM.COMMON_TERMS, 4):     # all vectors sent to the tasks, or only those of 4 words
        monkeypatch.setattr(TM, "COMMON_TERMS", common)
        assert {r.doc_id: r.keyphrases for r in TP.vector_keyphrases(d).collect()} == want
    plan = TP.vector_keyphrases(d.where("doc_id < 30"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, \d+\)", plan)) == 1 and "ObjectHashAggregate" in plan
    assert "WindowGroupLimit" in plan and "aggregate_metrics" not in plan


def test_topics_over_time_smooth_in_one_shuffle(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(rng.randint(1, 5))),
             f"2024-01-{rng.randint(1, 20):02d} 00:00:00") for _ in range(30)] + [(0, None, "2024-01-02 00:00:00")]
    score = {(t, w): (rng.randint(1, 64) / 64, 1 + ord(w[0]) / 128) for t in range(3) for w in ("alpha", "beta", "gamma", "delta")}
    d = spark.createDataFrame(rows, "topic int, text string, ts string")
    scores = spark.createDataFrame([(t, w, g, f) for (t, w), (g, f) in score.items()], "topic int, term string, score double, idf double")
    days = [int(ts[8:10]) for _, _, ts in rows]
    width = (max(days) - min(days)) / 6
    at = [min(max(math.ceil((x - min(days)) / width) - 1, 0), 5) for x in days]
    n, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for (t, text, _), b in zip(rows, at):
        docs[t, b] += 1
        n[t, b].update(w for w in (text or "").split() if (t, w) in score)
    want = {}
    for t, b in docs:
        before = max((x for y, x in docs if y == t and x < b), default=None)
        part = lambda x, w: n[t, x][w] / sum(n[t, x].values()) * score[t, w][1] if n[t, x][w] else 0.0
        top = sorted((w for y, w in score if y == t), key=lambda w: (-score[t, w][0], w))[:2]
        words = {*n[t, b], *top, *(n[t, before] if before is not None else ())}
        final = {w: ((part(b, w) if before is None else (part(b, w) + part(before, w)) / 2) + score[t, w][0]) / 2 for w in words}
        want[t, b] = (docs[t, b], ", ".join(sorted(final, key=lambda w: (-math.floor(final[w] * 1e10 + 0.5), w))[:2]))
    found = TP.topics_over_time(d, scores, _bin_counts, nr_bins=6, top_n=2)
    assert {(r.topic, r.bin): (r.frequency, r.words) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "_salt" not in plan.split("WindowGroupLimit")[0]
