"""Operators against brute force, and the defined results of edge cases."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agrisentinel.llm import (hashing, op1_decontaminate, op2_run_length_dedup, op3_mix, op4_perplexity,
                              op5_line_templates, op6_nbsvm, op7_language_evidence, op8_license_digests,
                              op9_separator_scan, op10_ngram_join)
from agrisentinel.llm.queries import QUERIES
from agrisentinel.session import checkpoint_root
from conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, hits string, score string, line string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "some words without an id here", "en", "b"),
    (5, LONG, "en", "b"), (6, LONG, "en", "b"), (7, "one two", "de", None), (7, "one two", "de", None),
    (8, "Ünïcode wörds ABC, ünd mehr Ünïcode", "de", "a"), (9, "a b c d e f g h i j k", "en", "a"),
]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, d, len(b or ""), "x", "x", "x", "x") for a, b, c, d in rows], SCHEMA)


def plain(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def family(seed, n, words=60, edits=6):
    """A base text, variants of it with random edits, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at: at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], "Extra"]])
        out.append(" ".join(w))
    return out + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(n)]


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("seed,k,num", [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, seed, k, num):
    texts = family(seed, 70) + ["x y", "x y", "", "x y z"]
    sets = shingle_sets(texts, k)
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= num * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = op10_ngram_join.similarity_classes(plain(spark, texts), shingle=k, num=num).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def test_jaccard_edges(spark, edge, nothing):
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in op10_ngram_join.similarity_classes(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 3, None), (7, 1, 7)} <= got
    assert {c for i, _, c in got if i in (5, 6)} == {5}
    assert op10_ngram_join.similarity_classes(nothing).count() == 0
    kept = op10_ngram_join.keep_one_per_class(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 5, 7, 8, 9, None]


def test_very_long_sets_sign_upwards():
    def scanned(n):  # a task of its own
        batch = pa.RecordBatch.from_arrays([pa.array([n]), pa.array([" ".join(map(str, range(n)))])], names=["id", "text"])
        return next(op10_ngram_join._scan(1, 85, 100)(iter([batch])))
    small, large = scanned(1_200_000), scanned(1_350_000)
    assert large["n_shingles"][0].as_py() == 1_350_000
    assert set(small["sigs_up"][0].as_py()) & set(large["sigs"][0].as_py())


def test_long_chain_of_links(spark):
    rng = random.Random(8)
    names = rng.sample(range(1000), 400)
    chain, rest = names[:200], names[200:]  # 200 in a row, the others at random
    pairs = list(zip(chain, chain[1:])) + [tuple(rng.sample(rest, 2)) for _ in range(120)]
    comp = {n: n for n in names}
    for _ in names:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    nodes = spark.createDataFrame([(n,) for n in names], "id long")
    got = op10_ngram_join.connected_components(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r["id"]: r["component"] for r in got} == comp and len(got) == len(names)


def brute_repeats(texts, length):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[s: s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in enumerate(raw):
        mask = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s: s + length]] > 1:
                mask[s: s + length] = True
        kept = bytes(v for v, m in zip(b, mask) if not m)
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [4096, 1])
def test_repeated_bytes(spark, monkeypatch, classes):
    monkeypatch.setattr(op2_run_length_dedup, "SHARD_CLASSES", classes)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(230))
    texts = family(3, 25, 90, 3) + ["ab" * 300, "q" * 450, passage + "tail one" * 30, "head" + passage, None, "", "q" * 199]
    texts += ["x" + "".join(rng.choice("abc ") for _ in range(150)) + passage[:200] + "y" for _ in range(5)]
    got = op2_run_length_dedup.remove_repeats(plain(spark, texts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_repeats(texts, 200)


def test_passage_in_many_different_documents(spark, monkeypatch):
    """Crowded routes are resolved window by window, and no shard takes them."""
    monkeypatch.setattr(op2_run_length_dedup, "SHARD_CLASSES", 8)
    monkeypatch.setattr(op2_run_length_dedup, "SHARD_BYTES", 16 << 10)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    near, whole = word(195), word(215)
    texts = [word(120) + near + word(120) for _ in range(300)] + [word(90) + whole + word(150) for _ in range(200)]
    texts += [texts[0], texts[310], "é" + near + "é" * 90]
    docs = plain(spark, texts)
    got = op2_run_length_dedup.remove_repeats(docs).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_repeats(texts, 200)
    scratch = checkpoint_root(spark).removeprefix("file:")
    parts, gone = (spark.read.parquet(max(glob.glob(f"{scratch}/agrisentinel/{name}-*"), key=os.path.getmtime))
                   for name in ("op2-parts", "op2-crowded"))
    assert gone.count() > 0
    left = parts.join(gone, "route", "left_anti").groupBy("route").agg(F.sum(F.octet_length("text")).alias("b"))
    assert left.agg(F.max("b")).first()[0] <= 16 << 10


def test_repeated_bytes_edges(spark, edge, nothing):
    got = op2_run_length_dedup.remove_repeats(edge)
    rows = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got.collect()}
    assert (5, len(LONG), len(LONG)) in rows and (6, len(LONG), len(LONG)) in rows and (1, 0, 0) in rows
    assert got.count() == len(EDGE)
    assert op2_run_length_dedup.remove_repeats(nothing).count() == 0


def test_run_length_index_samples():
    texts = [b"abracadabra", b"cadabra abra", b"zzzzzzzz"]
    index = op2_run_length_dedup.RunLengthIndex(texts)
    got = index.matching_statistics()
    places = [(t, i) for t in range(3) for i in range(len(texts[t]))]
    for (t, i), at in zip(places, [index.begin[t] + i for t, i in places]):
        best = 0
        for u, j in places:
            if (u, j) != (t, i):
                n = 0
                while i + n < len(texts[t]) and j + n < len(texts[u]) and texts[t][i + n] == texts[u][j + n]:
                    n += 1
                best = max(best, n)
        assert got[at] == best
    assert index.runs <= index.n


def test_contamination_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "C D e F"), (2, "one two"), (3, None), (4, "..."), (5, "Ünïcode"),
                                   (5, "Ünïcode"), (7, "ünïcode"), (6, "never seen words")], "item_id long, text string")
    got = op1_decontaminate.contamination(edge, items, window=10).collect()
    found = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got}
    assert len(got) == len(EDGE)
    assert {(9, 11, 4, ("1",)), (7, 2, 2, ("2",)), (1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ())} <= found
    assert (8, 6, 2, ("5",)) in found  # only A-Z is lower-cased, so the capital umlaut differs
    assert op1_decontaminate.contamination(nothing, items).count() == 0
    assert op1_decontaminate.contamination(edge, items.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_ids_of_several_texts(spark):
    docs = plain(spark, ["here red green blue stand", "one two three", "alpha beta gamma", "green red", "nothing of it"])
    items = spark.createDataFrame([(1, "red green blue"), (1, "one two three"), (1, "one two nowhere"),
                                   (None, "alpha beta gamma"), (None, "never seen")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in op1_decontaminate.contamination(docs, items).collect()}
    assert got == {0: (3, 1, ["1"]), 1: (3, 1, ["1"]), 2: (3, 1, [None]), 3: (0, 0, []), 4: (0, 0, [])}


def test_proximity(spark):
    docs = plain(spark, ["alpha x x beta", "beta alpha", "alpha " + "x " * 20 + "beta", "beta only"])
    ask = spark.createDataFrame([(1, "alpha beta"), (2, "only"), (3, "alpha nowhere")], "item_id long, text string")
    got = {(r["query"], r["doc"]) for r in op1_decontaminate.proximity_matches(docs, ask, slop=3).collect()}
    assert got == {(1, 0), (1, 1), (2, 3)}


def test_permutations():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(op3_mix.permute(np.arange(n), n, 9)) == list(range(n))


def test_mix(spark, edge, nothing):
    rows = QUERIES["op3_source_mixing"](spark, SMALL).collect()
    again = QUERIES["op3_source_mixing"](spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    source, taken = {}, Counter()
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        source[s] = (r["source_size"], r["target"])
        taken[s] += r["taken"]
        assert r["size"] == len(docs[r["doc_id"]]["text"].split()) and r["taken"] <= 3 * r["size"]
    names = sorted(source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(n for n, _ in source.values()), set()
    while True:  # targets stop at three times the size, the rest is shared anew
        level = (total - sum(3 * source[s][0] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 3 * source[s][0]}
        if not over:
            break
        full |= over
    for s in names:
        want = 3 * source[s][0] if s in full else level * weight[s]
        assert source[s][1] == pytest.approx(want) and abs(taken[s] - want) <= max(64, 0.02 * want)
    got = op3_mix.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert op3_mix.mix(nothing).count() == 0
    texts = op3_mix.mixed_texts(edge).agg(F.sum(F.size("words"))).first()[0]
    assert texts >= sum(r["taken"] for r in got)  # equal rows share their pieces


def test_quality_rules(spark, edge, nothing):
    text = "a b c a b c\nline x\n\nline x\n # $ \nline x"
    buf = np.frombuffer(text.encode(), np.uint8)
    got = op4_perplexity.base_counts(buf, np.array([0, len(buf)]))
    assert {k: int(v[0]) for k, v in got.items()} == {
        "n_words": 14, "word_chars": 6 + 15 + 2, "n_symbols": 2, "n_dup_lines": 2, "n_repeat_words": 6}
    rows = op4_perplexity.quality_rules(edge).collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows if (r["n_words"] or 0) < 50)
    assert op4_perplexity.quality_rules(nothing).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(["abcab abd", "abca", "bbbb", "cab cab"])])
    table = op4_perplexity.kneser_ney(op4_perplexity.ngram_counts(docs, order=3), 3)
    model = op4_perplexity.SortedModel(table.toArrow())
    for context in (b"ab", b"ca", b"zz"):
        keys = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.int64)
        assert np.exp(model.log_probability("=en", keys)).sum() == pytest.approx(1, abs=1e-5)


def brute_kneser_ney(texts, order):
    """log-probability function of byte n-grams, by plain counting."""
    counts = {order: Counter()}
    for t in texts:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i: i + order] for i in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    parts = {}
    for n, c in counts.items():
        of = [0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.0
        d = [0] + [max(0.0, k - (k + 1) * y * of[k + 1] / of[k]) if of[k] else k / 2 for k in (1, 2, 3)]
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += min(d[min(v, 3)], v)
        parts[n] = c, d, total, freed

    def probability(g):
        if not g:
            return 1 / 256
        c, d, total, freed = parts[len(g)]
        context, low = g[:-1], probability(g[1:])
        if not total[context]:
            return low
        return max(c[g] - d[min(c[g], 3)], 0) / total[context] + freed[context] / total[context] * low
    return probability


def test_model_against_plain_counting(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "aaaa aaab", "the cat sat"]
    docs = frame(spark, [(i, t, None, "a") for i, t in enumerate(texts)] + [(9, "xyz the zyx", "", "a")])
    model = op4_perplexity.SortedModel(op4_perplexity.kneser_ney(op4_perplexity.ngram_counts(docs, order=4), 4).toArrow())
    plain_p = brute_kneser_ney(texts, 4)
    grams = [b"the ", b"cat ", b" sat", b"aaaa", b"aaab", b"zzzz", b"he z", b"at o", bytes(3) + b"t", bytes(3) + b"q"]
    got = model.log_probability("", np.array([int.from_bytes(g, "big") for g in grams], np.int64))
    assert np.exp(got) == pytest.approx([plain_p(g) for g in grams], rel=1e-4)
    other = brute_kneser_ney(["xyz the zyx"], 4)  # the empty name is another language than null
    assert np.exp(model.log_probability("=", np.array([int.from_bytes(b" the", "big")])))[0] == pytest.approx(other(b" the"), rel=1e-4)


def test_bands_and_verdicts(spark):
    rows = [r.asDict() for r in op4_perplexity.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()]
    assert any(r["kept"] for r in rows)
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        passed = sorted(round(r["nll"] * 1000) / 1000 for r in own if not r["base_failed"])
        q1, q3 = (passed[math.ceil(q * len(passed)) - 1] for q in (0.25, 0.75))
        room = max(3 * (q3 - q1), 0.1)
        for r in own:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert (r["lower"], r["upper"]) == (pytest.approx(q1 - room, abs=2e-3), pytest.approx(q3 + room, abs=2e-3))
            assert r["kept"] == (not r["base_failed"] and r["lower"] <= r["nll"] <= r["upper"])


def test_word_salad_leaves_its_band(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.choice((1, 2, 3)))) for _ in range(300)]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(150)]
    texts = [". ".join(rng.sample(phrases, 12)) for _ in range(120)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(96)) for _ in range(4)]
    got = {r["doc_id"]: r for r in op4_perplexity.quality_rules(plain(spark, texts).withColumn("lang", F.lit("xx"))).collect()}
    assert all(got[i]["kept"] for i in range(120)) and not any(got[i]["kept"] for i in range(120, 124))


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    y = np.where([(3 in r) or (7 in r) for r in rows], 1.0, -1.0)
    ratio, cost = np.zeros(op6_nbsvm.DIMS), np.full(40, 0.7)
    ratio[:12] = rng.normal(size=12)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 12] = 1
    w = np.zeros(13)
    for _ in range(20_000):  # gradient steps on the primal
        slack = np.maximum(0, 1 - y * (x @ w))
        w -= 0.004 * (w - 2 * (cost * y * slack) @ x)
    got = op6_nbsvm.dual_coordinate_descent(rows, y, ratio, cost, epochs=400)
    assert np.r_[got[:12], got[op6_nbsvm.DIMS]] == pytest.approx(w, abs=1e-3)


def test_large_model_scores_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = op4_perplexity.kneser_ney(op4_perplexity.ngram_counts(docs, order=3), 3)
    one = {r["doc_id"]: r["nll"] for r in op4_perplexity.scores(docs, model).collect()}
    monkeypatch.setattr(op4_perplexity, "MODEL_ENTRIES", 0)
    assert {r["doc_id"]: r["nll"] for r in op4_perplexity.scores(docs, model).collect()} == one


def test_line_templates(spark, edge, nothing):
    prose = [" ".join(f"{chr(97 + i)}{chr(97 + j)}word" for j in range(16)) for i in range(12)]
    docs = plain(spark, [f"{p}\nPage {i} of 90 in this volume" for i, p in enumerate(prose)] + ["Page 1 of 90 in this volume", None])
    got = {r["doc_id"]: r for r in op5_line_templates.drop_recurring_lines(docs).collect()}
    assert all(got[i]["kept_text"] == prose[i] and got[i]["n_dropped"] == 1 for i in range(12))
    assert got[12]["n_dropped"] == 0 and got[12]["kept_text"] is not None  # nothing but a recurring line: a copy
    assert got[13]["kept_text"] is None and got[13]["n_lines"] == 0
    assert op5_line_templates.keep_other_lines(edge).columns == edge.columns
    assert op5_line_templates.keep_other_lines(edge).count() == len(EDGE)
    assert op5_line_templates.drop_recurring_lines(nothing).count() == 0


def test_lines_of_mostly_boilerplate_documents(spark):
    furniture = "all rights to these pages stay with the house\nwrite to our office for any further question"
    texts = [f"{furniture}\nown{i} text{i} of{i} this{i} document{i} alone{i}" for i in range(12)]
    copy = "Heading\n" + "\n".join(f"article line {c * 3} says one thing only {c}" for c in "abcdefg")
    got = {r["doc_id"]: r for r in op5_line_templates.drop_recurring_lines(plain(spark, texts + [copy] * 12)).collect()}
    assert all(got[i]["n_dropped"] == 2 and got[i]["kept_text"] == texts[i].split("\n")[2] for i in range(12))
    assert all(got[i]["n_dropped"] == 0 and got[i]["kept_text"] == copy for i in range(12, 24))


def test_short_lines(spark):
    prose = [" ".join(f"{chr(97 + i)}{chr(97 + j)}word" for j in range(26)) for i in range(12)]
    texts = [f"{p}\nRead more\n}}" + ("\nSeldom said" if i < 9 else "") for i, p in enumerate(prose)]
    got = {r["doc_id"]: r for r in op5_line_templates.drop_recurring_lines(plain(spark, texts)).collect()}
    assert all(got[i]["kept_text"] == t.replace("\nRead more", "") and got[i]["n_dropped"] == 1 for i, t in enumerate(texts))


def test_lines_alike_within_one_document(spark):
    prose = [" ".join(f"{chr(97 + i)}{chr(97 + j)}word" for j in range(26)) for i in range(12)]
    table = "\n".join(f"Row {i} of the table" for i in range(1, 11))
    far = "\n".join(f"Item {i} of {w} list" for i, w in ((1, "this"), (2, "that")))
    texts = [f"{prose[10]}\n{table}"] + [f"{prose[i]}\n{far}" for i in range(6)]  # 12 lines of a shape, 6 documents
    got = op5_line_templates.drop_recurring_lines(plain(spark, texts)).collect()
    assert all(r["n_dropped"] == 0 and r["kept_text"] == texts[r["doc_id"]] for r in got)
    texts += [f"{prose[i]}\n{far}" for i in range(6, 10)]
    got = op5_line_templates.drop_recurring_lines(plain(spark, texts)).collect()
    assert all(r["n_dropped"] == (0 if r["doc_id"] == 0 else 2) for r in got)


def test_classifier(spark, edge, nothing):
    rows = QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op6_nbsvm.quality_scores(edge, none).collect()} == {0.5}
    some = spark.createDataFrame([(5, 1), (9, 0), (9, None), (8, 1)], "doc_id long, quality int")
    scored = op6_nbsvm.quality_scores(edge, some).collect()
    assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scored)
    assert op6_nbsvm.quality_scores(nothing, some).count() == 0


def test_language(spark, edge, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pages = spark.createDataFrame([
        (1, "http://a.example.de/x", '<html lang="de"><p>der die das und nicht eine ung heit</p>', "x"),
        (2, None, None, "x"), (3, "http://a.example.de/y", "", "x"), (4, "http://b.example.fr/y", '<html lang="fr">', "x")],
        "page_id long, url string, html string, lang string")
    got = {r["page"]: r for r in op7_language_evidence.identify(pages, docs).collect()}
    assert got[1]["lang"] == "de" and got[3]["lang"] == "de" and got[2]["lang"] is not None
    assert got[3]["text_lang"] is None
    assert op7_language_evidence.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in op7_language_evidence.identify(pages, nothing).collect()} == {None}


def test_licences(spark, edge, nothing):
    docs = plain(spark, [
        "Copyright (c) 2020 Someone\n\n" + op8_license_digests.MIT.replace("Software", "SOFTWARE").replace("sublicense", "sub-license"),
        "prose\nreleased under the MIT licence\nmore", "permission is hereby granted", None, ""])
    got = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in op8_license_digests.scan(docs).collect()}
    assert got == {0: ("MIT", "MIT"), 1: (None, "MIT"), 2: (None, ""), 3: (None, ""), 4: (None, "")}
    assert op8_license_digests.scan(edge).count() == len(EDGE)
    assert op8_license_digests.scan(nothing).count() == 0


def test_licence_files(spark):
    text = {p.stem: p.read_text(encoding="utf-8") for p in op8_license_digests.TEXTS.glob("*.txt")}
    names = sorted(text)
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(names)
    files = [(n, text[n]) for n in names] + [
        ("MIT", "MIT License\n\nCopyright (c) 2021 Some One\n\n" + op8_license_digests.MIT + "\n"),
        ("ISC", "ISC License\n\nCopyright (c) 2021, Some One\n\n" + op8_license_digests.ISC),
        ("Apache-2.0", text["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some One")),
        ("Apache-2.0", text["Apache-2.0"].split("APPENDIX")[0]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, Some One\nAll rights reserved.\n\n" + "Redistribution"
         + text["BSD-3-Clause"].split("Redistribution", 1)[1].replace("the University", "the copyright holder")
         .replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR")),
        (None, "MIT License\n\nAll of the above may be had on request.")]
    got = {r["doc_id"]: r["whole_license"] for r in op8_license_digests.scan(plain(spark, [t for _, t in files])).collect()}
    assert [got[i] for i in range(len(files))] == [n for n, _ in files]


def test_separator_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    texts = ["", None, "one", LONG, "é ñ ü " * 50, " \n"] * 3
    plain(spark, texts).repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    want = {i: len(op9_separator_scan.encoder().encode_ordinary(t or "")) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["n_tokens"] for r in op9_separator_scan.document_tokens(docs).collect()}
    assert got == want
    folder = str(tmp_path / "tokens")
    op9_separator_scan.write_token_files(docs, folder)
    by_block = [sorted(map(tuple, op9_separator_scan.scan_token_files(spark, folder, b).collect())) for b in (2, 14, 1 << 20)]
    assert by_block[0] == by_block[1] == by_block[2]
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert op9_separator_scan.document_tokens(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_words_do_not_cross_documents():
    buf, off = np.frombuffer(b"ab cdef gh", np.uint8), np.array([0, 5, 5, 10])
    starts, ends, counts = hashing.word_bounds(buf, off)
    assert list(zip(starts, ends)) == [(0, 2), (3, 5), (5, 7), (8, 10)] and list(counts) == [2, 0, 2]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_duplicates", "decontamination", "mix"]
    left = corpus_pipeline.quality(spark, docs, SMALL)
    assert left.columns == docs.columns
    clean = {i for i, q in labels.items() if q == 1}
    assert len(clean & {r["doc_id"] for r in left.select("doc_id").collect()}) >= 0.95 * len(clean)
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() <= left.count()
