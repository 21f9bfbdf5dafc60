"""Spelling variants by pivotal grams.

Words at most one edit apart (one code point inserted, deleted or replaced) are
found with the pivotal prefix filter over bigrams:

* All bigrams have one global order, rarest first (ties by the gram); equal ones in a
  word follow by place.  A word's prefix is its ``PREFIX`` first grams in that order;
  where the last one's gram also stands one place on, that place is indexed too, since
  an edit may move it there.
* Its pivots are two disjoint grams of the prefix, chosen by dynamic programming
  for the least total frequency.  One edit touches at most one of two disjoint
  grams, so the other stands in the other word too, moved by at most one place.
* For two near words, take the one whose prefix ends first in the order: the pivot
  that survives is no later than the other prefix's end, so it stands in that
  prefix.  Pivots are looked up among prefixes by (gram, place, word length) with
  only the shifts that one edit allows: none at equal length, 0 or 1 otherwise.
* Candidates are verified by edit distance.

The words are a corpus' vocabulary, counted with partial aggregation; only distinct
words are joined.  The gram table is bounded by the square of the alphabet (90
letters: 8,100 rows), so it is gathered and sent to the tasks.  A word's form is its
near word of largest count; forms have at least ``ratio`` times the word's count,
so they cannot run in a circle, and roots follow by doubling steps.

Null or empty texts have no words; a null id counts as an empty one in the hash of
a slip; repeated rows count each time; extra columns are ignored; ties of counts go
to the smallest word; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, release

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q = 2
EDITS = 1
PREFIX = Q * EDITS + 1
PIVOTS = EDITS + 1


def with_slips(word: Column, doc_id: Column, every: int) -> Column:
    """``word`` without one code point where ``every`` divides the hash of id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
               slip_every: int | None = None) -> DataFrame:
    """``word, n``: maximal runs of letters, lower-cased (A-Z only), of at least ``min_length`` code points."""
    # a run that is too short stays so; greedy matching makes each match a maximal run
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    if slip_every:
        word = with_slips(word, F.col("id"), slip_every)
    return (words.select(word.alias("word")).where(F.length("word") >= min_length)
                 .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and frequency of every bigram of the words (at most alphabet squared)."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(Q)))
    counted = (words.where(F.length("word") >= Q).select(F.explode(grams).alias("gram"))
                    .groupBy("gram").agg(F.count(F.lit(1)).alias("f")).collect())
    return {g: (i, f) for i, (f, g) in enumerate(sorted((r.f, r.gram) for r in counted))}


def choose_pivots(grams: list[tuple[int, int]], pick: int = PIVOTS) -> list[int]:
    """Places of ``pick`` disjoint grams of least total frequency.

    ``grams`` are (place, frequency) in order of place.  ``best[i][j]`` is the least
    total of j disjoint grams among the first i, with the places that reach it.
    """
    none = (float("inf"), ())
    best = [[(0, ())] + [none] * pick]
    for i, (place, f) in enumerate(grams):
        before = i  # grams that end before this one begins
        while before and grams[before - 1][0] > place - Q:
            before -= 1
        row = [(0, ())]
        for j in range(1, pick + 1):
            total, places = best[before][j - 1]
            row.append(min(best[i][j], (total + f, (*places, place))))
        best.append(row)
    return list(best[-1][pick][1])


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Places of the indexed grams, places of the pivots, key of the prefix's last gram."""
    grams = [order[word[i: i + Q]] for i in range(len(word) - Q + 1)]
    first = heapq.nsmallest(PREFIX, ((rank, i) for i, (rank, _) in enumerate(grams)))
    rank, end = first[-1]
    places = sorted(i for _, i in first)
    moved = [end + 1] if end + 1 < len(grams) and grams[end + 1][0] == rank else []
    return places + moved, choose_pivots([(i, grams[i][1]) for i in places]), (rank << 32) + end


#: (change of length, change of place) of a gram that one edit leaves whole
SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]
ENTRY = "kind int, gram int, length int, place int, last long, word string"


def _entries(order: dict[str, tuple[int, int]]):
    """Index entries (kind 0) of a word's prefix and look-ups (kind 1) of its pivots."""
    types = [pa.int32()] * 4 + [pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                prefix, pivots, last = prefix_and_pivots(word, order)
                out += [(0, order[word[p: p + Q]][0], len(word), p, last, word) for p in prefix]
                out += [(1, order[word[p: p + Q]][0], len(word) + a, p + b, last, word)
                        for p in pivots for a, b in SHIFTS if p + b >= 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["kind", "gram", "length", "place", "last", "word"])
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` (a < b): all pairs of ``words`` (word, distinct, stored; PREFIX + 1 code points or more) one edit apart."""
    order = gram_order(words)
    entries = materialise(words.select("word").mapInArrow(_entries(order), ENTRY), "op13-grams")
    index = entries.where("kind = 0").drop("kind")
    probe = entries.where("kind = 1").select("gram", "length", "place", F.col("last").alias("end"), F.col("word").alias("x"))
    met = (probe.join(index.hint("merge"), ["gram", "length", "place"])
                .where((F.col("end") <= F.col("last")) & (F.col("x") != F.col("word")))
                .where(F.levenshtein("x", "word", 1) == 1)
                .select(F.least("x", "word").alias("a"), F.greatest("x", "word").alias("b")))
    pairs = materialise(met.distinct(), "op13-pairs")
    release(entries)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: steps double until no root has a form itself."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(further, "root", "left_semi").limit(1).count():
            return roots
        stepped = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                              "op13-roots")
        release(roots)
        roots = stepped


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                      min_count: int = 5, ratio: int = 5, slip_every: int | None = None) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` per word of the vocabulary."""
    if min_length < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} code points to have {PREFIX} bigrams")
    words = materialise(vocabulary(docs, id_col, text_col, min_length, min_count, slip_every), "op13-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = (both.join(counts.hint("merge"), "near").groupBy("word")
                .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    found = words.join(near.hint("merge"), "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    found = materialise(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "op13-forms")
    roots = _roots(found.where("form is not null").select("word", "form"))
    return (found.join(roots.hint("merge"), "word", "left")
                 .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
