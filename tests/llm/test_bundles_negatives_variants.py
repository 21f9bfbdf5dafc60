"""WARC bundles, hard negatives and spelling variants against brute force, and their edge cases."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrisentinel.llm import op11_warc_bundles as W
from agrisentinel.llm import op12_hard_negatives as H
from agrisentinel.llm import op13_pivotal_grams as P
from agrisentinel.session import scratch_path

# --- op11 -----------------------------------------------------------------------------

LONG = "".join(f"<p>{i} ünd so weiter</p>" for i in range(60_000))
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>same</p>"),
    (4, "http://a/with space\r\nX-Evil: 1", "own ü\r\n\r\ntext"), (5, "http://a/5", None), (6, "http://a/6", ""),
    (7, "http://a/7", LONG), (8, "http://a/8", LONG), (9, "http://a/9", "twin"), (9, "http://a/9", "twin"),
    (None, "http://a/x", "<p>same</p>"), (None, "http://a/y", "nobody's"), (12, "", "WARC/1.1\r\n\r\n"),
]
PAGE_SCHEMA = "page_id long, url string, html string, row long, digest string, payload string, record_id string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 5, "x", "x", "x") for a, b, c in rows], PAGE_SCHEMA)


def archived(rows, min_payload=0):
    """Digest, type and reference of each row by a plain scan."""
    best, out = {}, []
    for i, (page, _, html) in enumerate(rows):
        key = (html or "").encode()
        best[key] = max(best.get(key, (-1, -1)), (-1 if page is None else page, i))
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        top, at = best[body]
        revisit = i != at and len(body) >= min_payload
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", (None if top < 0 else top) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_payload", [0, 5])
def test_archive_equals_plain_scan(spark, min_payload):
    out = W.archive(pages_frame(spark, PAGES), min_payload=min_payload, frame_bytes=500)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == archived(PAGES, min_payload)


def test_hot_payloads_join_apart(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 3)
    got = sorted((tuple(r) for r in W.archive(pages_frame(spark, PAGES)).collect()), key=repr)
    assert got == archived(PAGES)


def test_empty_table_has_no_bundle(spark):
    assert W.archive(pages_frame(spark, [])).collect() == []


def test_bundles_are_plain_zstandard_and_seekable(spark):
    import zstandard

    folder = scratch_path(spark, "test-bundles")
    index = W.write_archives(pages_frame(spark, PAGES).coalesce(1), folder, frame_bytes=300, bundle_bytes=100_000)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({r.record_id for r in rows}) == len(PAGES)
    files, path = W._filesystem(folder)
    for name in {r.bundle for r in rows}:
        with files.open_input_file(f"{path}/{name}") as source:
            table = W.seek_table(source)
            frames = [W._open_frame(source, *f) for f in table]
        whole = zstandard.ZstdDecompressor().stream_reader(open(f"{path}/{name}", "rb"), read_across_frames=True).read()
        assert whole == b"".join(frames)
        mine = [r for r in rows if r.bundle == name]
        assert sum(r.length for r in mine) == len(whole)
        for r in mine:
            record = frames[r.frame][r["at"]: r["at"] + r.length]
            head, _, end = W.parse_record(record, 0)
            assert head["warc-record-id"] == f"<{r.record_id}>" and end == len(record)
            assert "x-evil" not in head


def test_fetch_reads_wanted_records(spark):
    folder = scratch_path(spark, "test-bundles")
    index = W.write_archives(pages_frame(spark, PAGES), folder, frame_bytes=400)
    ids = [r.record_id for r in index.collect() if W.page_of(r.record_id) in ("2", "3", "4", "8")]
    wanted = spark.createDataFrame([(i,) for i in [*ids, "urn:page:77:1"]], "record_id string")
    found = {r.id: r for r in W.fetch(index, folder, wanted).collect()}
    assert set(found) == {"2", "3", "4", "8"}
    assert bytes(found["4"].payload).decode() == PAGES[3][2] and bytes(found["8"].payload).decode() == LONG
    assert found["2"].record_type == "revisit" and found["2"].payload is None
    assert found["2"].refers_to == found["3"].record_id


def test_a_changed_payload_is_noticed():
    record = W.warc_record("1", 1, "u", b"abc", 3, hashlib.sha1(b"abd").digest(), None, "2025-01-01T00:00:00Z")
    head, block, _ = W.parse_record(record, 0)
    with pytest.raises(ValueError, match="digest"):
        W._describe(head, block)


# --- op12 -----------------------------------------------------------------------------

def mined(rows, positives=5, negatives=3, low=50, high=95):
    """Every pair scored."""
    kept = [(i, lab, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, lab, v in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (ai, al, av) in enumerate(kept):
        if ai % 50:
            continue
        scored = [(-int(av @ v), i, lab) for b, (i, lab, v) in enumerate(kept) if b != a]
        for p, pi, _ in sorted(x for x in scored if x[2] == al)[:positives]:
            fits = sorted(x for x in scored if x[2] != al and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(ai, pi, r, ni, -p, -n) for r, (n, ni, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, d=8, groups=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if groups:
        x = rng.normal(size=(groups, d))[rng.integers(groups, size=n)] * 3 + x * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(rng.integers(4)), [float(v) for v in row]) for i, row in enumerate(x)]


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, 1, "x") for i, lab, v in rows],
                                 "vec_id long, label long, embedding array<float>, row long, cluster long, q string")


def mine(spark, rows):
    out = H.hard_negatives(vec_frame(spark, rows), F.col("id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_equals_scoring_every_pair(spark):
    rows = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in vectors(1, 900)]
    assert mine(spark, rows) == mined(rows)


def test_bands_slices_and_chunks_change_nothing(spark, monkeypatch):
    for name, value in {"ANCHORS_PER_CLUSTER": 6, "MEMBERS": 4, "SLICE": 100}.items():
        monkeypatch.setattr(H, name, value)
    rows = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in vectors(2, 1500, groups=6)]
    assert mine(spark, rows) == mined(rows)


def test_walk_stops_before_the_end_of_the_list():
    """On separate groups the bound certifies the stop; what lies behind is never scored."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=(3000, 8)) * 0.02 + np.eye(8)[0]
    far = rng.normal(size=(6000, 8)) * 0.02 - np.eye(8)[0]
    q = np.floor(256 * np.vstack([near, far])).astype(np.int32)
    centre = H.unit(q[:3000].mean(axis=0, keepdims=True))[0]
    widest = H.angles(H.unit(q[:50])[0], centre).max(keepdims=True)[0]
    lists = H.Lists(centre, widest, float(H.unit(q)[1].max()))
    bound = lists.bounds(q)[:, 0]
    order = np.lexsort((np.arange(len(q)), -bound))
    listed = {"row": order, "id": order, "label": np.zeros(len(q), np.int64), "bound": bound[order], "q": q[order]}
    listed["q"][4000:] = 1 << 20  # would win if they were read
    one = np.ones((50, 1), np.int64)
    members = {"row": np.arange(50), "label": np.zeros(50, np.int64), "q": q[:50], "norm": H.unit(q[:50])[1],
               "low": one * H.LEAST, "need": one * H.LEAST, "high": one * H.MOST}
    member, _, score, other = H.walk(members, listed, True, 5, True)
    plain = q[:50].astype(np.int64) @ q[:3000].T.astype(np.int64)
    for m in range(50):
        want = sorted((-plain[m, i], i) for i in range(3000) if i != m)[:5]
        assert list(zip(-score[member == m], other[member == m])) == want


def test_odd_vectors(spark):
    rows = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in vectors(5, 300, d=4)]
    same = rows[100][2]
    odd = [(None, 1, same), (50, None, same), (51, 1, None), (52, 1, [1.0, None, 0.0, 0.0]), (53, 2, [float("nan")] * 4),
           (54, 2, [float("inf"), 0.0, 0.0, 0.0]), (55, 1, [0.0] * 4), (350, 1, [0.0] * 4), (56, 3, []),
           (150, rows[150][1], rows[150][2]), (100, rows[100][1], same)] + [(400 + i, i % 4, same) for i in range(20)]
    assert mine(spark, rows + odd) == mined(rows + odd)
    assert mine(spark, rows + [(700, 1, [1.0, 2.0])]) == mined(rows)  # another width takes no part
    assert mine(spark, []) == []
    assert mine(spark, [(1, 1, same), (2, 2, same)]) == []  # no anchor
    assert mine(spark, [(0, 1, same), (2, 1, same)]) == []  # one label


def test_scores_beyond_double_precision(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 2), [float(np.float32(x)) for x in rng.integers(-2_000_000, 2_000_000, size=4)]) for i in range(60)]
    assert mine(spark, rows) == mined(rows)


# --- op13 -----------------------------------------------------------------------------

def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(docs, every=None, min_length=6, min_count=5, ratio=5):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(P.UPPER, P.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    near = {w: [v for v in n if edit_one(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out, key=repr)


def docs_frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", "x", 1) for d, t in docs],
                                 "doc_id long, text string, word string, near string, n long")


def grouped(spark, docs, **options):
    out = P.spelling_variants(docs_frame(spark, docs), **options)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("letters", ["ab", "abcü", "abcdefghijÀÿ"])
def test_near_words_equal_all_pairs(spark, letters):
    """Few letters: grams repeat inside words and are frequent among them."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(220)}
    for w in list(words)[:120]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]))
    words = sorted(w for w in words if len(w) >= 4)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.a, r.b) for r in P.near_pairs(frame).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(words, 2) if edit_one(a, b)}


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(4)
    for _ in range(200):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        grams = [(p, rng.randint(1, 30)) for p in places]
        pivots = P.choose_pivots(grams)
        cost = dict(grams)
        cheapest = min(cost[a] + cost[b] for a, b in itertools.combinations(places, 2) if b - a >= 2)
        assert pivots[1] - pivots[0] >= 2 and cost[pivots[0]] + cost[pivots[1]] == cheapest


def test_variants_equal_brute_force(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("aeinrsté") for _ in range(rng.randint(6, 8))) for _ in range(60)]
    docs = []
    for d in range(300):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.15)), 59)]
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice("aeinrst") + w[i + rng.randint(0, 1):]
            words.append(w.title() if rng.random() < 0.2 else w)
        docs.append((d, " ".join(words) + ", x-y 12"))
    got = grouped(spark, docs, slip_every=19)
    assert got == variants(docs, every=19)
    assert any(form for _, _, _, form, _, _ in got)


def test_chains_of_forms_reach_their_root(spark):
    """Each word has five times the count of the one before, one edit on."""
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    docs = [(i, " ".join([w] * (5 * 5 ** i))) for i, w in enumerate(chain)]
    got = {r[0]: r for r in grouped(spark, docs)}
    assert {w: r[5] for w, r in got.items()} == dict.fromkeys(chain, "aaaabbbb")
    assert grouped(spark, docs) == variants(docs)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "  12 34 short ones"), (None, "Straßen Straßen Straßen Straßen Straßen Straßen"),
            (4, "Résumés " * 7), (4, "Résumés " * 7), (5, "résumés " * 80), (6, "École×÷ß " * 5), (6, "x" * 50_000 + " "),
            (7, ("y" * 40_000 + " ") * 5), (8, "ÀÉÎÕÜß " * 6 + "àéîõüß " * 6), (9, "don't won't " * 9)]
    assert grouped(spark, docs) == variants(docs)
    assert grouped(spark, docs, slip_every=3) == variants(docs, every=3)
    assert grouped(spark, [(1, None), (2, "few words")]) == []
    assert grouped(spark, []) == []
    with pytest.raises(ValueError):
        P.spelling_variants(docs_frame(spark, []), min_length=3)
