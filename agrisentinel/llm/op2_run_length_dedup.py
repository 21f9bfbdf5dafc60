"""Exact substring dedup with run-length Burrows-Wheeler indexes.

Every byte covered by a ``length``-byte string that also starts anywhere else
(same document included) is marked; strings never cross documents and are
judged on the input.

1. *Sampling.*  Each ``length``-byte window has one anchor: the leftmost
   smallest hash among its ``gram``-byte substrings.  The anchor depends on the
   window's bytes alone, so equal windows have equal anchors at equal offsets.
   The consecutive windows of one anchor form an item (about 80 windows); one
   small row stands for it.  Items whose anchor occurs once hold no repeat.
2. *Classes.*  Items that are equal in all their bytes form a class; when an
   anchor has a single class, all its windows repeat.
3. *Index.*  The classes that share an anchor with other classes are routed by
   the anchor's hash to index shards of a few MB (an anchor with very many
   classes is routed by longer common substrings).  A shard builds the
   run-length BWT of its classes, keeps the suffix-array samples at the run ends
   with their irreducible longest common prefixes, and streams the classes
   through it in text order: between samples the match length falls by one per
   byte, so the samples alone give every matching statistic.  Windows whose
   match with a neighbour reaches ``length`` are marked.
   Where very many different classes hold one of those longer strings (a passage
   of nearly ``length`` bytes in any number of documents), one shard could not
   take them: the string that routes their windows grows to the whole window, so
   equal windows meet as partial counts and no task gathers the group.
4. Marks go back to the members of each class and are merged per document.

Null or empty texts, and texts shorter than ``length``, have no marks.  Repeated
rows are separate places, so a long text that is there twice goes in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .tables import broadcast_if_small, materialise

U = np.uint64
GRAM = 40
SLICE = 1 << 20
#: bytes of class texts in one index shard, and classes of one anchor in it
SHARD_BYTES = 1 << 20
SHARD_CLASSES = 2048
STEP = 32
ITEMS = "h long, ctx long, id long, tkey long, lo int, n int, at int"


def anchor_items(buf: np.ndarray, length: int, gram: int):
    """``(h, ctx, lo, n, at)`` of one document: anchor hash, hash of all bytes of
    the item's windows, first window, number of windows, anchor's place in it."""
    out = []
    wide = length - gram + 1
    last = len(buf) - length  # start of the last window
    for base in range(0, last + 1, SLICE):
        windows = min(SLICE, last + 1 - base)
        part = buf[base: base + windows + length - 1]
        p = H.prefix_sums(part)
        grams = len(part) - gram + 1
        s = np.arange(grams)
        full = H.range_hash(p, s, s + gram)
        value = (full & ~U((1 << 22) - 1)) | s.astype(U)
        padded = np.full(-(-grams // wide) * wide + wide, np.iinfo(np.uint64).max, U)
        padded[:grams] = value
        blocks = padded.reshape(-1, wide)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[:windows], left[wide - 1: wide - 1 + windows])
        at = (least & U((1 << 22) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[lo, windows])
        at = at[lo]
        ctx = H.mix(H.range_hash(p, lo, lo + n - 1 + length) + (at - lo).astype(U))
        out.append((full[at], ctx, lo + base, n, at - lo))
    return [np.concatenate(x) for x in zip(*out)]


def _items(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
            buf, off = H.text_bytes(batch.column(2))
            parts, held = [], 0
            for d in range(len(off) - 1):
                if off[d + 1] - off[d] >= length:
                    h, ctx, lo, n, at = anchor_items(buf[off[d]: off[d + 1]], length, gram)
                    parts.append((h, ctx, np.full(len(h), ids[d]), np.full(len(h), keys[d]), lo, n, at))
                    held += len(h)
                if parts and (held > 100_000 or d == len(off) - 2):
                    h, ctx, i, k, lo, n, at = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(H.signed(h)), pa.array(H.signed(ctx)), pa.array(i), pa.array(k),
                         pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))],
                        names=["h", "ctx", "id", "tkey", "lo", "n", "at"])
                    parts, held = [], 0
    return run


class RunLengthIndex:
    """Run-length BWT of texts (each ended by its own, smallest symbol).

    ``heads``/``tails`` are the text positions sampled at the ends of the BWT's
    runs, ``head_lcp``/``tail_lcp`` their longest common prefixes with the
    preceding/following suffix.  Everything is vectorised over one shard.
    """

    PACK = 7  # symbols 0..256 in one 64-bit word

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        n = int((sizes + 1).sum())
        self.n = n
        sym = np.zeros(n, np.int64)
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sym[:] = raw
        sym += 1
        ends = self.begin + sizes
        sym[ends] = 0
        self.end = np.repeat(ends, sizes + 1)  # position of the own separator
        levels = self._ranks(sym)
        order = np.argsort(levels[-1][1], kind="stable")
        before = np.r_[-1, sym[:-1]]
        text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        before[self.begin] = -1 - text_of[self.begin]  # separators differ from each other
        bwt = before[order]
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = len(change) + 1
        starts = np.r_[0, change]
        stops = np.r_[change - 1, n - 1]
        self.heads, self.tails = order[starts], order[stops]
        up, down = starts[1:], stops[:-1]
        self.head_lcp = np.zeros(self.runs, np.int64)
        self.tail_lcp = np.zeros(self.runs, np.int64)
        self.head_lcp[1:] = self._lcp(levels, sym, order[up], order[up - 1])
        self.tail_lcp[:-1] = self._lcp(levels, sym, order[down], order[down + 1])

    def _ranks(self, sym: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Ranks of the suffixes by their first d symbols, for doubling d.  Nothing
        after a text's separator is compared."""
        n = self.n
        pos = np.arange(n)
        key = np.zeros(n, np.int64)
        for j in range(self.PACK):
            at = pos + j
            inside = at <= self.end
            key = key * 257 + np.where(inside, sym[np.minimum(at, n - 1)], 0)
        depth, levels = self.PACK, []
        longest = int((self.end - pos).max()) + 1
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
            levels.append((depth, rank))
            if depth >= longest:
                return levels
            at = pos + depth
            key = rank * (n + 1) + np.where(at <= self.end, rank[np.minimum(at, n - 1)], 0)
            depth *= 2

    def _lcp(self, levels, sym: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        got = np.zeros(len(a), np.int64)
        for depth, rank in reversed(levels):
            at = np.minimum(got, most)
            same = (rank[a + at] == rank[b + at]) & (got < most)
            got += np.where(same, depth, 0)
        for _ in range(self.PACK - 1):
            at = np.minimum(got, most)
            got += (sym[a + at] == sym[b + at]) & (got < most)
        return np.minimum(got, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position of the texts, the longest match that starts there and
        at any other position: streamed in text order from the samples."""
        out = np.zeros(self.n, np.int64)
        for places, lcp in ((self.heads, self.head_lcp), (self.tails, self.tail_lcp)):
            # from sample to sample the length falls by one per symbol
            reach = np.full(self.n, -1, np.int64)
            order = np.argsort(places)
            placed = places[order]
            nearest = np.searchsorted(placed, np.arange(self.n), "right") - 1
            known = nearest >= 0
            reach[known] = (lcp[order] + placed)[nearest[known]]
            out = np.maximum(out, reach - np.arange(self.n))
        return np.minimum(out, self.end - np.arange(self.n))


def _resolve(length: int):
    """Index one shard; repeated windows of each of its rows as [lo, hi) ranges."""
    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        windows = table.column("n").to_numpy()
        copies = table.column("copies").to_numpy()
        index = RunLengthIndex(texts)
        long_match = index.matching_statistics() >= length
        lo, hi = [], []
        for i, (b, n) in enumerate(zip(index.begin, windows)):
            hit = np.ones(n, np.int8) if copies[i] > 1 else long_match[b: b + n].astype(np.int8)
            edge = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
            lo.append(edge[::2].tolist())
            hi.append(edge[1::2].tolist())
        return pa.table({"h": table.column("h"), "ctx": table.column("ctx"), "off": table.column("off"),
                         "from_w": pa.array(lo, pa.list_(pa.int32())), "to_w": pa.array(hi, pa.list_(pa.int32()))})
    return run


def _merge(length: int):
    """Byte spans of each document from its window ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.array(a, np.int64), np.array(b, np.int64) + length - 1
                order = np.lexsort((b, a))
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.r_[True, a[1:] > b[:-1]]
                lo.append(a[new].tolist())
                hi.append(b[np.r_[new[1:], True]].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64()))],
                names=["id", "tkey", "span_lo", "span_hi"])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(text_col).alias("tkey"),
                       F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))


def _repeated_windows(parts: DataFrame, length: int) -> DataFrame:
    """Marks of the ``parts`` whose route is crowded, window by window: a window is
    told by its route and the hash of its bytes, and repeats where two places hold it."""
    each = F.expr(f"transform(sequence(0, n - 1), i -> xxhash64(substring(text, i + 1, {length})))")
    # hashes instead of texts; stored, so that AQE can split both sides of the join
    windows = materialise(parts.select("h", "ctx", "off", "copies", "route", each.alias("w")), "op2-windows")
    windows = windows.select("h", "ctx", "off", "copies", "route", F.posexplode("w").alias("i", "w"))
    again = materialise(windows.groupBy("route", "w").agg(F.sum("copies").alias("c")).where("c > 1").select("route", "w"),
                        "op2-again")
    hit = windows.join(broadcast_if_small(again, 16), ["route", "w"], "left_semi")
    return (hit.groupBy("h", "ctx", "off").agg(F.sort_array(F.collect_list("i")).alias("from_w"))  # STEP at most
               .select("h", "ctx", "off", "from_w", F.transform("from_w", lambda x: x + 1).alias("to_w")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 200, gram: int = GRAM) -> DataFrame:
    """``docs`` keyed and with ``span_lo, span_hi``: the removable byte spans
    (null: none).  Columns: id, tkey, doc, text (binary), span_lo, span_hi."""
    keyed = _keyed(docs, id_col, text_col)
    spark: SparkSession = docs.sparkSession
    items = materialise(keyed.where(F.octet_length("text") >= length).select("id", "tkey", "text")
                             .mapInArrow(_items(length, gram), ITEMS), "op2-items")
    # stored first, so that the join's two sides are plain exchanges, which AQE can split
    often = materialise(items.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "op2-often")
    members = materialise(items.join(often, "h", "left_semi"), "op2-members")
    classes = materialise(
        members.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("copies"),
                                        F.min(F.struct("id", "tkey", "lo", "n", "at")).alias("rep")), "op2-classes")
    width = materialise(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("rep.n").alias("windows")),
                        "op2-anchors")
    alone = classes.join(width.where("k = 1").select("h"), "h", "left_semi").select(
        "h", "ctx", F.array(F.lit(0)).alias("from_w"), F.array(F.col("rep.n")).alias("to_w"))
    mixed = classes.join(width.where("k > 1").select("h", "k"), "h").select(
        "h", "ctx", "copies", "k", "rep.id", "rep.tkey", "rep.lo", "rep.n", "rep.at")
    # an anchor with very many classes is split by the offset of its windows
    j = F.when(F.col("k") <= SHARD_CLASSES, F.array(F.lit(-1))).otherwise(
        F.sequence(F.floor((F.col("at") - F.col("n") + 1) / STEP).cast("int"), F.floor(F.col("at") / STEP).cast("int")))
    mixed = mixed.withColumn("j", F.explode(j))
    off = F.when(F.col("j") < 0, 0).otherwise(F.greatest(F.lit(0), F.col("at") - STEP * F.col("j") - (STEP - 1)))
    end = F.when(F.col("j") < 0, F.col("n")).otherwise(F.least(F.col("n"), F.col("at") - STEP * F.col("j") + 1))
    mixed = mixed.withColumns({"off": off.cast("int"), "end": end.cast("int")})
    mixed = materialise(mixed.groupBy("id", "tkey").agg(F.collect_list(
        F.struct("h", "ctx", "copies", "lo", "off", "end", "j", "at")).alias("parts")), "op2-mixed")
    wanted = docs_of = keyed.select("id", "tkey", "text")
    docs_of = wanted.join(broadcast_if_small(mixed.select("id", "tkey"), 48), ["id", "tkey"], "left_semi")
    docs_of = docs_of.dropDuplicates(["id", "tkey"])
    cut = F.expr(f"""transform(parts, x -> named_struct('h', x.h, 'ctx', x.ctx, 'copies', x.copies,
        'off', x.off, 'n', x.end - x.off,
        'text', substring(text, x.lo + x.off + 1, x.end - x.off + {length - 1}),
        'split', x.j >= 0,
        'route', if(x.j < 0, x.h, xxhash64(x.h, x.j, substring(text, x.lo + x.at - {STEP} * x.j + 1, {length - STEP + 1})))))""")
    parts = docs_of.join(mixed, ["id", "tkey"]).select(F.explode(cut).alias("x")).select("x.*")
    parts = materialise(parts, "op2-parts")
    crowded = materialise(parts.where("split").groupBy("route").agg(F.sum(F.col("n") + (length - 1)).alias("size"))
                               .where(F.col("size") > SHARD_BYTES // 4).select("route"), "op2-crowded")
    crowd = broadcast_if_small(crowded, 8)
    indexed = parts.join(crowd, "route", "left_anti")
    total = indexed.agg(F.coalesce(F.sum(F.col("n").cast("long") + (length - 1)), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD_BYTES))
    found = (indexed.groupBy(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"))
                    .applyInArrow(_resolve(length), "h long, ctx long, off int, from_w array<int>, to_w array<int>"))
    found = found.unionByName(_repeated_windows(parts.join(crowd, "route", "left_semi"), length))
    found = materialise(
        found.select("h", "ctx", F.transform("from_w", lambda x: x + F.col("off")).alias("from_w"),
                     F.transform("to_w", lambda x: x + F.col("off")).alias("to_w")).where("size(from_w) > 0"),
        "op2-found").unionByName(alone)
    marks = (members.join(found, ["h", "ctx"])
                    .select("id", "tkey", F.explode(F.arrays_zip("from_w", "to_w")).alias("r"), "lo")
                    .select("id", "tkey", (F.col("lo") + F.col("r.from_w")).alias("a"),
                            (F.col("lo") + F.col("r.to_w")).alias("b"))
                    .groupBy("id", "tkey").agg(F.collect_list(F.struct("a", "b")).alias("r"))
                    .select("id", "tkey", F.col("r.a").alias("a"), F.col("r.b").alias("b")))
    spans = materialise(marks.mapInArrow(
        _merge(length), "id long, tkey long, span_lo array<long>, span_hi array<long>"), "op2-spans")
    ranges = spans.agg(F.coalesce(F.sum(F.size("span_lo")), F.lit(0))).first()[0]
    rows = max(1, spans.count())
    return keyed.join(broadcast_if_small(spans, 48 + 16 * -(-int(ranges) // rows)), ["id", "tkey"], "left")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = H.text_bytes(batch.column(1))
        kept, removed, spans = [], [], []
        for d, (lo, hi) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            text = buf[off[d]: off[d + 1]].tobytes()
            gone = list(zip(lo or (), hi or ()))
            at, rest = 0, []
            for a, b in gone:
                rest.append(text[at:a])
                at = b
            rest.append(text[at:])
            kept.append(b"".join(rest))
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256`` per row of ``docs``."""
    spans = repeated_spans(docs, id_col, text_col, length)
    return spans.select(F.col("doc").cast("long").alias("doc_id"), "text", "span_lo", "span_hi").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
