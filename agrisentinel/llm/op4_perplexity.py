"""Quality rules with n-gram perplexity bands.

Base counts follow from whole texts (words ``[^\\x20\\x09-\\x0D]+``).  The verdict
comes from a modified Kneser-Ney model per language over byte n-grams of order
``ORDER``, counted by Spark over every text: highest order by occurrence, lower
orders by distinct left neighbours, three discounts per order and language from
the counts of counts, interpolated down to the uniform distribution.  The model
is stored as one sorted array of 64-bit n-gram keys with log-probabilities and
back-off weights per language and order; documents are scored by binary search.
A model beyond ``MODEL_ENTRIES`` is not sent whole: the distinct n-grams of chunks
of documents meet it by key, and each chunk is scored with the values it needs.

A document's perplexity (negative log-probability of all its bytes over its bytes
of letters and digits, so that signs raise it) must lie in its language's band: the quartiles
of the documents that pass the base rules, widened by ``spread`` times their
distance (``least`` nats at least, in logarithms) either way.  Quartiles come
from exact counts per 0.001 nats.

Null and empty texts have no words and fail the base rule; a null language is a
language of its own; repeated rows count as often as they occur; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tables import materialise

U = np.uint64
ORDER = 5
#: n-grams of a model that goes to every scoring task (16 bytes each there); a
#: larger one is joined by key to the n-grams of chunks of documents
MODEL_ENTRIES = 6_000_000
#: bytes of text in such a chunk
CHUNK_TEXT = 8 << 20
COMPACT = 4_000_000
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngram_keys(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte the key of the ``order`` bytes that end with it (earlier
    first); places before the text count as byte 0."""
    sizes = np.diff(off)
    padded = np.zeros(len(buf) + (order - 1) * len(sizes), np.int64)
    shift = np.repeat((np.arange(len(sizes)) + 1) * (order - 1), sizes)
    at = np.arange(len(buf)) + shift
    padded[at] = buf
    key = np.zeros(len(buf), np.int64)
    for j in range(order - 1, -1, -1):
        key = (key << 8) | padded[at - j]
    return key


def _by_language(batch: pa.RecordBatch, lang_at: int, text_at: int):
    """(language, row numbers, bytes, offsets) of a batch, about CHUNK_BYTES each."""
    lang = ["" if x is None else f"={x}" for x in batch.column(lang_at).to_pylist()]  # null is not the empty name
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(lang):
        rows.setdefault(name, []).append(i)
    for name, at in rows.items():
        buf, off = H.text_bytes(pc.take(batch.column(text_at), pa.array(at)))
        for i, j in H.chunks(off):
            yield name, np.array(at[i:j]), buf[off[i]: off[j]], off[i: j + 1] - off[i]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], np.add.reduceat(counts, begin)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for name, _, buf, off in _by_language(batch, 0, 1):
                if not len(buf):
                    continue
                held.setdefault(name, []).append(np.unique(ngram_keys(buf, off, order), return_counts=True))
                size[name] = size.get(name, 0) + len(held[name][-1][0])
                if size[name] > COMPACT:
                    held[name] = [_summed(held[name])]
                    size[name] = len(held[name][0][0])
        for name, parts in held.items():
            keys, counts = _summed(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(keys), pa.array(counts.astype(np.int64))],
                names=["lang", "key", "c"])
    return run


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``lang, key, c`` of every text of the corpus."""
    return (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
                .mapInArrow(_count(order), "lang string, key long, c long")
                .groupBy("lang", "key").agg(F.sum("c").alias("c")))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, n, key, logp, backoff``: interpolated log-probability of each n-gram,
    and log of the weight its lower order gets when it is a context (null: 1)."""
    by_order = {order: materialise(counts, "op4-counts")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 8 * n) - 1)
        by_order[n] = materialise(by_order[n + 1].groupBy("lang", suffix.alias("key")).agg(F.count(F.lit(1)).alias("c")),
                                  f"op4-counts{n}")
    lower, out = None, None
    for n in range(1, order + 1):
        c = by_order[n]
        coc = c.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
        def discount(k, a, b, start):
            return F.when(F.col(a) > 0, F.greatest(F.lit(0.0), F.lit(float(start)) - k * y * F.col(b) / F.col(a))).otherwise(
                F.lit(float(start) / 2))
        coc = coc.select("lang", discount(2, "n1", "n2", 1).alias("d1"), discount(3, "n2", "n3", 2).alias("d2"),
                         discount(4, "n3", "n4", 3).alias("d3"))
        c = c.join(coc, "lang").withColumns({
            "context": F.shiftrightunsigned("key", 8),
            "d": F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))})
        totals = c.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(F.least("d", "c")).alias("freed"))
        c = c.join(totals, ["lang", "context"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        share = F.col("freed") / F.col("total")
        if lower is None:
            p = c.withColumn("p", own + share / 256)
        else:
            p = c.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(
                lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("p_low")), ["lang", "suffix"])
            p = p.withColumn("p", own + share * F.col("p_low"))
        lower = materialise(p.select("lang", "key", "p"), f"op4-p{n}")
        grams = lower.select("lang", F.lit(n).alias("n"), "key", F.log("p").alias("logp"))
        weights = totals.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("key"),
                                F.log(F.greatest(F.col("freed") / F.col("total"), F.lit(1e-12))).alias("backoff"))
        table = grams.select("*", F.lit(None).cast("double").alias("backoff")).unionByName(
            weights.select("lang", "n", "key", F.lit(None).cast("double").alias("logp"), "backoff"))
        out = table if out is None else out.unionByName(table)
    return materialise(out.groupBy("lang", "n", "key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")),
                       "op4-model")


class SortedModel:
    """Sorted key arrays per (language, n); looked up by binary search."""

    def __init__(self, table: pa.Table):
        coded = pa.chunked_array(table.column("lang").chunks, pa.string()).combine_chunks().dictionary_encode()
        lang = coded.indices.to_numpy(False)
        n, key = table.column("n").to_numpy(), table.column("key").to_numpy()
        logp = table.column("logp").to_pandas().to_numpy(np.float64)
        backoff = table.column("backoff").to_pandas().to_numpy(np.float64)
        self.parts = {}
        for code, name in enumerate(coded.dictionary.to_pylist()):  # none for an empty corpus
            for order in range(0, int(n.max()) + 1):
                pick = np.flatnonzero((lang == code) & (n == order))
                pick = pick[np.argsort(key[pick], kind="stable")]
                self.parts[name, order] = (key[pick], logp[pick].astype(np.float32),
                                           np.nan_to_num(backoff[pick]).astype(np.float32))
        self.order = int(n.max()) if len(n) else 0

    def _find(self, lang: str, n: int, keys: np.ndarray):
        stored = self.parts.get((lang, n), (np.zeros(0, np.int64),) * 3)
        if not len(stored[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), stored
        at = np.minimum(np.searchsorted(stored[0], keys), len(stored[0]) - 1)
        return stored[0][at] == keys, at, stored

    def log_probability(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Of each n-gram key (its last byte given the others), backing off."""
        out, todo, carried = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
        for n in range(self.order, 0, -1):
            k = keys[todo] & ((1 << 8 * n) - 1)
            hit, at, stored = self._find(lang, n, k)
            hit &= ~np.isnan(stored[1][at]) if len(stored[0]) else False
            out[todo[hit]] = carried[todo[hit]] + stored[1][at[hit]]
            todo, k = todo[~hit], k[~hit]
            if not len(todo):
                return out
            known, at, stored = self._find(lang, n - 1, k >> 8)
            carried[todo[known]] += stored[2][at[known]]
        out[todo] = carried[todo] - np.log(256)
        return out


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per document."""
    docs = len(off) - 1
    starts, ends, counts = H.word_bounds(buf, off)
    p = H.prefix_sums(buf)
    word = H.range_hash(p, starts, ends)
    per_doc = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][off])
    inked = ~H.SPACE[buf]
    out = {"n_words": counts, "word_chars": per_doc(inked & ((buf & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[buf])}
    cut = np.flatnonzero(buf == 10)
    line_lo = np.unique(np.r_[off[:-1], cut + 1])
    line_lo = line_lo[line_lo < len(buf)]
    doc = np.searchsorted(off, line_lo, "right") - 1
    line_hi = np.minimum(np.r_[line_lo[1:], len(buf)], off[doc + 1])
    ends_in_cut = (line_hi > line_lo) & (buf[np.maximum(line_hi - 1, 0)] == 10)
    line_hi = line_hi - ends_in_cut
    ink = np.r_[0, np.cumsum(inked)]
    full = ink[line_hi] > ink[line_lo]
    tag = H.mix(H.range_hash(p, line_lo[full], line_hi[full]) + doc[full].astype(U) * U(0x9E3779B97F4A7C15))
    _, first = np.unique(tag, return_index=True)
    out["n_dup_lines"] = np.bincount(doc[full], minlength=docs) - np.bincount(doc[full][first], minlength=docs)
    long = np.where(counts >= 3, counts - 2, 0)
    first_word = np.cumsum(counts) - counts
    at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(first_word, long)
    owner = np.repeat(np.arange(docs), long)
    window = H.mix(H.window_hash(word, at, 3) + owner.astype(U) * U(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    hit = np.zeros(len(word) + 2, bool)
    for j in range(3):
        hit[again + j] = True
    word_off = np.r_[0, np.cumsum(counts)]
    out["n_repeat_words"] = np.diff(np.r_[0, np.cumsum(hit[: len(word)])][word_off])
    return {k: v.astype(np.int64) for k, v in out.items()}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", nll double"
EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
                  **{c: pa.array([], pa.int64()) for c in COUNTS}, "nll": pa.array([], pa.float64())})


def _score_batch(batch: pa.RecordBatch, model: SortedModel) -> pa.RecordBatch:
    """Columns doc_id, lang, text to SCORED."""
    got = {c: np.zeros(batch.num_rows, np.int64) for c in COUNTS}
    nll = np.full(batch.num_rows, np.nan)
    for name, rows, buf, off in _by_language(batch, 1, 2):
        for c, v in base_counts(buf, off).items():
            got[c][rows] = v
        keys, inverse = np.unique(ngram_keys(buf, off, model.order or 1), return_inverse=True)
        total = np.r_[0, np.cumsum(model.log_probability(name, keys)[inverse])]
        size = np.diff(np.r_[0, np.cumsum(LETTERS[buf])][off])
        nll[rows] = np.where(size > 0, -(total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1), np.nan)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()), batch.column(1), *[pa.array(got[c]) for c in COUNTS],
         pa.array(np.round(nll, 6), from_pandas=True)], names=["doc_id", "lang", *COUNTS, "nll"])


def scores(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", lang_col: str = "lang",
           text_col: str = "text") -> DataFrame:
    """Base counts and negative log-probability per byte of letters and digits (``nll``) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if model.count() <= MODEL_ENTRIES:
        small = model.select("lang", "n", "key", F.col("logp").cast("float"), F.col("backoff").cast("float"))
        shared = docs.sparkSession.sparkContext.broadcast(SortedModel(small.toArrow()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _score_batch(batch, shared.value)
        return rows.mapInArrow(score, SCORED)

    # a large model: the distinct n-grams of chunks of documents meet it by key, and each
    # chunk gets back the values of its own n-grams alone
    order = int(model.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(max(1, -(-int(size) // CHUNK_TEXT))))
    dealt = materialise(rows.withColumn("chunk", chunk), "op4-dealt")
    keys = materialise(dealt.groupBy("chunk").applyInArrow(_chunk_keys(order), "chunk long, lang string, key long"),
                       "op4-chunk-keys")
    known = keys.join(look_up(keys.select("lang", "key").distinct(), model, order), ["lang", "key"])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        own = SortedModel(right)
        done = [_score_batch(b, own) for b in left.select(["doc_id", "lang", "text"]).to_batches()]
        return pa.Table.from_batches(done) if done else EMPTY
    return (dealt.groupBy("chunk").cogroup(
                known.select(F.col("chunk").alias("of"), "lang", F.lit(order).alias("n"), "key", "logp",
                             F.lit(None).cast("float").alias("backoff")).groupBy("of"))
                 .applyInArrow(lambda a, b: together(a, b.drop_columns(["of"])), SCORED))


def _chunk_keys(order: int):
    def run(table: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for batch in table.select(["lang", "text"]).to_batches():
            for name, _, buf, off in _by_language(batch, 0, 1):
                held.setdefault(name, []).append(np.unique(ngram_keys(buf, off, order)))
        found = {name: np.unique(np.concatenate(parts)) for name, parts in held.items()}
        sizes = [len(k) for k in found.values()]
        return pa.table({"chunk": pa.array(np.full(sum(sizes), table.column("chunk")[0].as_py(), np.int64)),
                         "lang": pa.array(list(found), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                         "key": pa.array(np.concatenate([*found.values(), np.zeros(0, np.int64)]))})
    return run


def look_up(keys: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``lang, key, logp`` of distinct n-gram keys by joins, backing off from order to order."""
    todo, found = keys.withColumn("carried", F.lit(0.0)), None
    for n in range(order, 0, -1):
        own = F.col("key").bitwiseAND((1 << 8 * n) - 1)
        grams = model.where((F.col("n") == n) & F.col("logp").isNotNull()).select("lang", F.col("key").alias("own"), "logp")
        met = materialise(todo.withColumn("own", own).join(grams, ["lang", "own"], "left"), f"op4-met{n}")
        hit = met.where("logp is not null").select("lang", "key", (F.col("carried") + F.col("logp")).cast("float").alias("logp"))
        found = hit if found is None else found.unionByName(hit)
        weights = model.where((F.col("n") == n - 1) & F.col("backoff").isNotNull()).select(
            "lang", F.col("key").alias("context"), "backoff")
        todo = (met.where("logp is null").withColumn("context", F.shiftrightunsigned("own", 8))
                   .join(weights, ["lang", "context"], "left")
                   .select("lang", "key", (F.col("carried") + F.coalesce("backoff", F.lit(0.0))).alias("carried")))
    return found.unionByName(todo.select("lang", "key", (F.col("carried") - math.log(256)).cast("float").alias("logp")))


def perplexity_bands(scored: DataFrame, spread: float = 3.0, least: float = 0.1) -> DataFrame:
    """``lang, lower, upper`` (nats per byte) from rows that pass the base rules."""
    bins = (scored.where(~F.col("base_failed")).groupBy("lang", F.round(F.col("nll") * 1000).cast("long").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("c")))
    # the bins of a language are bounded by its range of nats, a few thousand rows
    per_lang = bins.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("b"), F.sum("c").alias("n"))

    def quantile(q: float):
        reach = F.aggregate(
            "b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"),
                                  F.when(s["at"].isNull() & (s["seen"] + x["c"] >= F.lit(q) * F.col("n")), x["bin"])
                                   .otherwise(s["at"]).alias("at")))
        return reach["at"] / 1000.0
    got = per_lang.select("lang", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    room = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), F.lit(least))
    return got.select("lang", (F.col("q1") - room).alias("lower"), (F.col("q3") + room).alias("upper"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
                  order: int = ORDER) -> DataFrame:
    """Base counts, ``base_failed, nll, perplexity, lower, upper, kept`` per row."""
    model = kneser_ney(ngram_counts(docs, lang_col, text_col, order), order)
    scored = scores(docs, model, id_col, lang_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = materialise(scored.withColumn("base_failed", failed), "op4-scored")
    bands = F.broadcast(perplexity_bands(scored))  # a row per language
    out = scored.alias("s").join(bands.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
    inside = F.coalesce(F.col("nll").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("s.*", F.exp("nll").alias("perplexity"), "lower", "upper",
                      (~F.col("base_failed") & inside).alias("kept"))
