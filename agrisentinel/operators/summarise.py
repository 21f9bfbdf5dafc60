"""Chunked extractive summaries.

The reference asks a language model for ≤ 4 sentences per chunk of ≤ 4,096
tokens and joins the chunk summaries.  Here the chunking is the same and the
summary is extractive: every sentence is scored by the mean inverse document
frequency of its words over the corpus, and the best ``max_sentences`` are
kept in their original order.  All steps are explodes, joins and groupBys;
the text is processed whole (no prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .terms import drop_stop_words, tokens

SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def whitespace_tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.trim(t), r"\s+")


def chunks(text: Column | str, max_tokens: int = 4096) -> Column:
    """``[text]`` verbatim when it has ≤ max_tokens whitespace tokens,
    else consecutive chunks of max_tokens tokens (the last one shorter)."""
    t = F.col(text) if isinstance(text, str) else text
    tok = whitespace_tokens(t)
    n = F.size(tok)
    split = F.transform(F.sequence(F.lit(0), n - 1, F.lit(max_tokens)),
                        lambda i: F.array_join(F.slice(tok, i + 1, max_tokens), " "))
    return F.when(n <= max_tokens, F.array(t)).otherwise(split)


def chunk_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text",
               max_tokens: int = 4096) -> DataFrame:
    """One row per chunk: ``id, chunk_idx, chunk``."""
    return df.select(id_col, F.posexplode(chunks(text, max_tokens)).alias("chunk_idx", "chunk"))


def chunk_count(text: Column | str, max_tokens: int = 4096) -> Column:
    """Number of ``chunks`` of a text (a null text has none), without building them."""
    return F.coalesce(F.greatest(F.ceil(F.size(whitespace_tokens(text)) / max_tokens), F.lit(0)), F.lit(0))


def idf_table(corpus: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, idf = ln(N / df)`` over the corpus (stop words removed)."""
    n_docs = corpus.select(F.count(F.lit(1))).scalar()
    toks = F.array_distinct(drop_stop_words(tokens(text)))
    dfreq = (corpus.select(id_col, F.explode(toks).alias("term"))
                   .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return dfreq.select("term", F.log(n_docs / F.col("df")).alias("idf"))


def extractive_summaries(df: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id",
                         text: str = "text", max_tokens: int = 4096,
                         max_sentences: int = 4) -> DataFrame:
    """``id, summary``; blank or sentence-less texts give ``""``."""
    from ..plans.rounding import fround
    corpus = corpus if corpus is not None else df
    idf = idf_table(corpus, id_col, text)
    # no summary reaches a null id, so its rows need not meet
    ch = chunk_rows(df.where((F.trim(F.col(text)) != "") & F.col(id_col).isNotNull()), id_col, text, max_tokens)
    ch = ch.select(id_col, "chunk_idx", F.transform(
        F.regexp_extract_all("chunk", F.lit(SENTENCE_PATTERN), 0), lambda x: F.trim(x)).alias("sentences"))
    # texts cross one shuffle, by chunk; terms and scores travel with keys alone
    sents = ch.select(id_col, "chunk_idx", F.posexplode("sentences").alias("sent_idx", "sentence"))
    occ = sents.select(id_col, "chunk_idx", "sent_idx",
                       F.explode(drop_stop_words(tokens("sentence"))).alias("term"))
    words = occ.join(idf, "term").select(id_col, "chunk_idx", "sent_idx", "idf")
    # every sentence has a row, so that a score's place in the list is its sentence's
    scores = (words.unionByName(sents.select(id_col, "chunk_idx", "sent_idx", F.lit(None).cast("double").alias("idf")))
                   .groupBy(id_col, "chunk_idx", "sent_idx").agg(F.avg("idf").alias("score"))
                   .groupBy(id_col, "chunk_idx").agg(F.transform(
                       F.array_sort(F.collect_list(F.struct("sent_idx", fround(F.coalesce("score", F.lit(0.0)), 8).alias("score")))),
                       lambda s: s["score"]).alias("scores")))
    ranked = F.array_sort(F.transform("sentences", lambda x, i: F.struct(
        (-F.element_at("scores", i + 1)).alias("by"), i.alias("sent_idx"), x.alias("sentence"))))
    # chunks of one id and number (repeated ids) share the places
    best = (ch.join(scores, [id_col, "chunk_idx"])
              .select(id_col, "chunk_idx", F.slice(ranked, 1, max_sentences).alias("best"))
              .groupBy(id_col, "chunk_idx").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, max_sentences).alias("best")))
    per_chunk = best.select(id_col, "chunk_idx", F.array_join(F.transform(F.array_sort(F.transform(
        "best", lambda s: F.struct(s["sent_idx"], s["sentence"]))), lambda s: s["sentence"]), " ").alias("chunk_summary"))
    per_doc = per_chunk.groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_summary"))),
        lambda s: s["chunk_summary"]), " ").alias("summary"))
    return (df.select(id_col).join(per_doc, id_col, "left")
              .select(id_col, F.coalesce("summary", F.lit("")).alias("summary")))


def prompts(chunks_df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """The instruction around each chunk."""
    return chunks_df.withColumn("prompt", T.prompt(chunk))
