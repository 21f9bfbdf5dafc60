"""Vectorised byte and word hashing inside Arrow batches.

Texts of a batch are hashed without a Python loop over words: a prefix sum of
``value(byte) * BASE**position`` (mod 2**64) gives the hash of any byte range in
O(1), because BASE is odd and so has an inverse.  Hashes are finished with a
64-bit mixer.  Equal byte ranges always hash equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

# Bytes of [\x20\x09-\x0D], the separators of all word-based operators here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (grown as needed, kept per worker)."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """``p`` with hash(buf[s:e]) = (p[e] - p[s]) * BASE**-s."""
    up, _ = powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], dtype=U, out=p[1:])
    return p


def range_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[e] - p[s]) * down[s] + U(0xD6E8FEB86659FD93) * (e - s).astype(U))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string/binary column and its ``n + 1`` offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset: column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]]
    return buf, off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together (one at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and words per document."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[buf], out=inside[1:-1])
    is_start = inside[1:-1] & ~inside[:-2]
    is_end = inside[1:-1] & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    is_start[cut] = inside[cut + 1]
    is_end[cut - 1] = inside[cut]
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def window_hash(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each ``first``."""
    h = np.full(len(first), k, U)
    for j in range(k):
        h = mix(h + words[first + j])
    return h


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles of every document, in order, with how many each has.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    first = np.cumsum(counts) - counts
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.cumsum(per_doc) - per_doc
    at = np.arange(per_doc.sum()) - np.repeat(begin, per_doc) + np.repeat(first, per_doc)
    full = np.repeat(counts >= k, per_doc)
    out = np.zeros(len(at), U)
    out[full] = window_hash(words, at[full], k)
    for length in range(1, k):
        short = np.flatnonzero(counts == length)
        out[begin[short]] = window_hash(words, first[short], length)
    return out, per_doc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
