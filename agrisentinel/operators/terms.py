"""Term statistics (J5–J7, D19, J15 twin, F1).

Tokens, stop words and n-grams are array expressions (JVM); counting is
``explode`` + ``groupBy`` with partial aggregation, so a very frequent term
is pre-counted in every task.  Class-based TF-IDF (Grootendorst 2022) is a
few aggregations and equi-joins over the long (class, term, n) table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import spark_stop_words
from ..session import cut_lineage, store
from .common import top_k_per_group

BROADCAST_IDS = 250_000
COMMON_TERMS = 50_000
SLICE = 1 << 19     # tokens whose pairs are held at a time
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of ≥ 2 word characters, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def drop_stop_words(toks: Column, stop: Sequence[str] | None = None) -> Column:
    """Remove stop words, keeping order and repeats (``x IN (...)`` becomes a
    hash-set lookup)."""
    words = list(stop if stop is not None else spark_stop_words())
    return F.filter(toks, lambda x: ~x.isin(words))


def ngrams(toks: Column, n_max: int = 2) -> Column:
    """Unigrams + bigrams (joined by a space), formed after stop-word removal."""
    out = toks
    if n_max >= 2:
        n = F.size(toks)
        bi = F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))),
                        F.slice(toks, 2, F.greatest(n - 1, F.lit(0))),
                        lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(toks, bi)
    return out


def content_tokens(df: DataFrame, keep: Sequence[str], text: str = "text",
                   stop: Sequence[str] | None = None, name: str = "_tok") -> DataFrame:
    """Projection holding the stop-word-free token array as its own column,
    so later expressions (size, slices, bigrams) reuse it instead of
    re-running the regex (Catalyst does not collapse a costly projection
    that is referenced more than once)."""
    return df.select(*keep, drop_stop_words(tokens(text), stop).alias(name))


def doc_terms(df: DataFrame, id_cols: Sequence[str], text: str = "text",
              stop: Sequence[str] | None = None, n_max: int = 2) -> DataFrame:
    """Long table ``(*id_cols, term)``: one row per term occurrence."""
    t = content_tokens(df, id_cols, text, stop)
    return t.select(*id_cols, F.explode(ngrams(F.col("_tok"), n_max)).alias("term"))


def class_term_counts(df: DataFrame, cls: str = "topic", text: str = "text",
                      stop: Sequence[str] | None = None, n_max: int = 2,
                      min_df: int = 2, by: str = "class") -> DataFrame:
    """``(class, term, n)``; terms present in fewer than ``min_df``
    classes (``by='class'``, the vectoriser fitted on one text per class) or
    documents (``by='doc'``) are dropped."""
    ids = [cls] if by == "class" else [cls, "doc_id"]
    occ = doc_terms(df, ids, text, stop, n_max)
    if by == "class":
        n = occ.groupBy(cls, "term").agg(F.count(F.lit(1)).alias("n"))
        df_t = n.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    else:
        per_doc = occ.groupBy(cls, "doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
        n = per_doc.groupBy(cls, "term").agg(F.sum("n").alias("n"))
        df_t = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    keep = df_t.where(F.col("_df") >= min_df).select("term")
    return n.join(keep, "term", "left_semi")


def class_tfidf(counts: DataFrame, cls: str = "topic") -> DataFrame:
    """``score = n(t,c)/Σ_t n(t,c) · ln(1 + A / f(t))`` with ``f(t)`` the
    term's total frequency and ``A`` the average number of words per class
    (truncated to an integer, as the public implementation does).

    ``counts`` feeds four branches (lengths, frequencies, the average and the
    scores), so it is materialised once with a reliable checkpoint.
    """
    counts = cut_lineage(counts)
    length = counts.groupBy(cls).agg(F.sum("n").alias("_len"))
    freq = counts.groupBy("term").agg(F.sum("n").alias("_f"))
    avg_words = F.floor(length.select(F.avg("_len")).scalar())
    idf = F.log(1 + avg_words / F.col("_f"))
    return (counts.join(length, cls).join(freq, "term")
                  .select(cls, "term", "n", ((F.col("n") / F.col("_len")) * idf).alias("score"),
                          idf.alias("idf")))


def top_terms(scores: DataFrame, k: int = 10, cls: str = "topic", score: str = "score",
              digits: int = 10) -> DataFrame:
    """F1: top-k terms per class by score (rounded, so engines agree), then term."""
    from ..plans.rounding import fround
    r = scores.withColumn("_s", fround(score, digits))
    return top_k_per_group(r, [cls], [F.desc("_s"), F.asc("term")], k,
                           salt_key=[cls, "term"]).drop("_s")


def doc_frequency(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                  stop: Sequence[str] | None = None) -> DataFrame:
    """Number of documents containing each unigram."""
    toks = F.array_distinct(drop_stop_words(tokens(text), stop))
    return (df.select(id_col, F.explode(toks).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def by_repeats(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id occurs once, and those of repeated ids (the null id too), if any."""
    repeated = store(df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                       .select(F.col(id_col).alias("_again")), "repeated-ids")
    n = repeated.count()
    if not n:
        return df, None
    again = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def vocabulary(df: DataFrame, id_col: str = "doc_id", text: str = "text", stop: Sequence[str] | None = None,
               n_max: int = 2, min_df: int = 2) -> DataFrame:
    """``term, df``: ids whose text holds the term, for terms of ``min_df`` ids or more.

    Rows of one id (the null id too) count as one document.  Where an id has one
    row, its distinct terms come from its own array and no (id, term) rows are
    shuffled; only the rows of repeated ids meet by id.
    """
    return _vocabulary(*by_repeats(df, id_col), id_col, text, stop, n_max, min_df)


def _vocabulary(once: DataFrame, again: DataFrame | None, id_col: str, text: str, stop: Sequence[str] | None,
                n_max: int, min_df: int) -> DataFrame:
    terms = content_tokens(once, [id_col], text, stop).select(
        F.explode(F.array_distinct(ngrams(F.col("_tok"), n_max))).alias("term"))
    if again is not None:
        terms = terms.unionByName(doc_terms(again, [id_col], text, stop, n_max).distinct().select("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def _term_frequency(once: DataFrame, again: DataFrame | None, id_col: str, text: str,
                    stop: Sequence[str] | None) -> DataFrame:
    """``id_col, term, tf``; a row whose id occurs once counts its own sorted array."""
    t = content_tokens(once, [id_col], text, stop).select(id_col, F.array_sort("_tok").alias("_tok"))
    first = F.filter("_tok", lambda x, i: (i == 0) | (F.get("_tok", i - 1) != x))
    starts = F.filter(F.transform("_tok", lambda x, i: F.when((i == 0) | (F.get("_tok", i - 1) != x), i)), lambda i: i.isNotNull())
    t = t.select(id_col, F.size("_tok").alias("_n"), first.alias("_first"), starts.alias("_at"))
    tf = t.select(id_col, F.explode(F.transform("_first", lambda x, i: F.struct(
        x.alias("term"), (F.coalesce(F.get("_at", i + 1), "_n") - F.get("_at", i)).cast("long").alias("tf")))).alias("_t")
                  ).select(id_col, "_t.term", "_t.tf")
    if again is not None:
        tf = tf.unionByName(doc_terms(again, [id_col], text, stop, 1).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    return tf


def keyphrases_tfidf(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                     k: int = 5, stop: Sequence[str] | None = None) -> DataFrame:
    """J15 twin: per document the k unigrams with highest count · ln(N/df),
    joined by ``"; "`` in rank order.

    The frequencies of the ``COMMON_TERMS`` most frequent terms are sent to every
    task, which scores their occurrences in place; the other occurrences meet
    their term's frequency by a shuffle.  Before documents are put together each
    task keeps its best k of a document.
    """
    from ..plans.rounding import fround
    n_docs = df.select(F.count(F.lit(1))).scalar()
    parts = by_repeats(df, id_col)
    dfreq = store(_vocabulary(*parts, id_col, text, stop, 1, 1), "term-df")
    common = store(dfreq.orderBy(F.desc("df"), "term").limit(COMMON_TERMS), "common-df")
    tf = _term_frequency(*parts, id_col, text, stop)
    met = tf.join(F.broadcast(common), "term")
    rest = tf.join(F.broadcast(common), "term", "left_anti").join(dfreq.join(common, "term", "left_anti"), "term")
    scored = met.unionByName(rest).select(id_col, "term", fround(F.col("tf") * F.log(n_docs / F.col("df")), 8).alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc("term"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (top.groupBy(id_col)
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                             lambda s: s["term"]), "; ").alias("keyphrases")))


def _code(term: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), term)


def _coded(tok: DataFrame) -> tuple[int, DataFrame]:
    """A seed under which no two of the terms share a hash, and ``code, term, df`` (stored) under it."""
    terms = store(tok.select(F.explode(F.array_distinct("_tok")).alias("term"))
                     .groupBy("term").agg(F.count(F.lit(1)).alias("df")), "cooc-terms")
    seed = 0
    while True:
        coded = terms.select(_code("term", seed).alias("code"), "term", "df")
        if not coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return seed, coded
        seed += 1


def _neighbouring(codes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a < b, documents``: pairs of different codes within ``window`` positions, each counted once per document."""
    known, at = np.unique(codes, return_inverse=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for d in range(1, min(window, len(at) - 1) + 1):
        near = (doc[:-d] == doc[d:]) & (at[:-d] != at[d:])
        x, y = at[:-d][near], at[d:][near]
        found.append((np.minimum(x, y) * len(known) + np.maximum(x, y)) * len(sizes) + doc[d:][near])
    if not found:
        return known[:0], known[:0], known[:0]
    keys = np.sort(np.concatenate(found))
    pairs = keys[np.diff(keys, prepend=-1) != 0] // len(sizes)
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs, n = pairs[starts], np.diff(starts, append=len(pairs))
    return known[pairs // len(known)], known[pairs % len(known)], n


def _count_pairs(window: int):
    """Batches of ``codes`` to ``a, b, n``; documents of ``SLICE`` codes in all, or one longer one, at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            first = done = 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
                a, b, n = _neighbouring(values[done: ends[last - 1]], sizes[first: last], window)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])
                first, done = last, int(ends[last - 1])
    return run


def cooccurrence(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 5,
                 min_df: int = 2, stop: Sequence[str] | None = None) -> DataFrame:
    """Term pairs within ``window`` positions of each other (after stop
    words), counted once per document; both terms must occur in at least
    ``min_df`` documents.

    Terms are counted as 64-bit hashes that no two of the corpus share (a seed is
    taken that keeps them apart).  Pairs are built and counted in tasks, some
    documents at a time, so the work is linear in text length and there is no
    self-join; the counts of all tasks are added by pair, and what is left meets
    the terms of ``min_df`` documents or more.
    """
    tok = store(content_tokens(df, [id_col], text, stop), "cooc-tokens")
    seed, terms = _coded(tok)
    codes = tok.select(F.transform("_tok", lambda x: _code(x, seed)).alias("codes")).where(F.size("codes") > 1)
    counts = (codes.mapInArrow(_count_pairs(window), "a long, b long, n long")
                   .groupBy("a", "b").agg(F.sum("n").alias("n_docs")))
    frequent = terms.where(F.col("df") >= min_df)
    return (counts.join(frequent.select(F.col("code").alias("a"), F.col("term").alias("_a")), "a")
                  .join(frequent.select(F.col("code").alias("b"), F.col("term").alias("_b")), "b")
                  .select(F.least("_a", "_b").alias("term_a"), F.greatest("_a", "_b").alias("term_b"), "n_docs"))
