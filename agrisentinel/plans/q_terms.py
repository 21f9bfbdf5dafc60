"""Registered queries: tokens, vocabulary, class TF-IDF, co-occurrence and
key phrases (J5–J7, F1, D19, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms as TM
from ..sources.tables import table
from . import sqltext as Q
from .fixtures import view, with_views
from .registry import query
from .rounding import fround, sround as R

TOP_WORDS = 10
COOC_WINDOW = 5


@query("j5_tokenize", f"""
SELECT doc_id, len(t) AS n_tokens, len(c) AS n_content, len({Q.with_bigrams('c')}) AS n_terms
FROM (SELECT doc_id, t, {Q.no_stop('t')} AS c
      FROM (SELECT doc_id, {Q.tok('text')} AS t FROM documents) a) b""")
def j5_tokenize(spark, sf):
    d = table(spark, sf, "documents")
    t = d.select("doc_id", TM.tokens("text").alias("t"))
    c = t.select("doc_id", "t", TM.drop_stop_words(F.col("t")).alias("c"))
    return c.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size("c").cast("bigint").alias("n_content"),
                    F.size(TM.ngrams(F.col("c"))).cast("bigint").alias("n_terms"))


@query("j5_vocabulary_min_df", f"""
SELECT term, count(DISTINCT doc_id) AS df FROM ({Q.terms_cte('documents', 'doc_id')}) o
GROUP BY term HAVING count(DISTINCT doc_id) >= 2""")
def j5_vocab(spark, sf):
    return TM.vocabulary(table(spark, sf, "documents"))


COUNTS_SQL = f"""
SELECT topic, term, count(*) AS n FROM ({Q.terms_cte('topics', 'topic')}) o
WHERE term IN (SELECT term FROM ({Q.terms_cte('topics', 'topic')}) o2
               GROUP BY term HAVING count(DISTINCT topic) >= 2)
GROUP BY topic, term"""

CTFIDF_SQL = f"""
SELECT n.topic, n.term, n.n, {R("n.n / l.len * ln(1 + a.A / f.f)", 10)} AS score
FROM counts n JOIN (SELECT topic, sum(n) AS len FROM counts GROUP BY topic) l ON l.topic = n.topic
JOIN (SELECT term, sum(n) AS f FROM counts GROUP BY term) f ON f.term = n.term
CROSS JOIN (SELECT floor(avg(len)) AS A FROM (SELECT topic, sum(n) AS len FROM counts
            GROUP BY topic) x) a"""


def class_scores(spark, sf):
    counts = TM.class_term_counts(view(spark, sf, "topics"))
    return TM.class_tfidf(counts)


@query("j6_min_df_classes", with_views(f"""
SELECT term, count(DISTINCT topic) AS n_classes FROM ({Q.terms_cte('topics', 'topic')}) o
GROUP BY term HAVING count(DISTINCT topic) >= 2""", "topics"))
def j6_min_df(spark, sf):
    occ = TM.doc_terms(view(spark, sf, "topics"), ["topic"])
    return (occ.groupBy("term").agg(F.count_distinct("topic").alias("n_classes"))
               .where(F.col("n_classes") >= 2))


@query("j7_class_tfidf", with_views(CTFIDF_SQL, "topics", extra={"counts": COUNTS_SQL}))
def j7_ctfidf(spark, sf):
    s = class_scores(spark, sf)
    return s.select("topic", "term", "n", fround("score", 10).alias("score"))


@query("f1_top_words_per_topic", with_views(f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, score FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank
  FROM ({CTFIDF_SQL}) s) t WHERE rank <= {TOP_WORDS}""", "topics", extra={"counts": COUNTS_SQL}))
def f1_top_words(spark, sf):
    s = TM.top_terms(class_scores(spark, sf), TOP_WORDS)
    return s.select("topic", "rank", "term", fround("score", 10).alias("score"))


@query("d19_cooccurrence", f"""
WITH toks AS (SELECT doc_id, {Q.no_stop(Q.tok('text'))} AS c FROM documents),
pos AS (SELECT doc_id, unnest(range(0, len(c))) AS p, unnest(c) AS term FROM toks),
freq AS (SELECT term FROM pos GROUP BY term HAVING count(DISTINCT doc_id) >= 2),
kept AS (SELECT * FROM pos WHERE term IN (SELECT term FROM freq)),
pairs AS (SELECT DISTINCT a.doc_id, least(a.term, b.term) AS term_a, greatest(a.term, b.term) AS term_b
          FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p - a.p BETWEEN 1 AND {COOC_WINDOW}
          WHERE a.term <> b.term)
SELECT term_a, term_b, count(*) AS n_docs FROM pairs GROUP BY term_a, term_b HAVING count(*) >= 2""")
def d19_cooc(spark, sf):
    c = TM.cooccurrence(table(spark, sf, "documents"), window=COOC_WINDOW)
    return c.where(F.col("n_docs") >= 2)


@query("j15_keyphrases_tfidf", f"""
WITH occ AS (SELECT doc_id, unnest({Q.no_stop(Q.tok('text'))}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT tf.doc_id, tf.term,
              {R("tf.tf * ln((SELECT count(*) FROM documents) / dfq.df)", 8)} AS score
       FROM tf JOIN dfq ON dfq.term = tf.term),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM sc)
SELECT doc_id, string_agg(term, '; ' ORDER BY rank) AS keyphrases FROM rk WHERE rank <= 5
GROUP BY doc_id""")
def j15_keyphrases(spark, sf):
    return TM.keyphrases_tfidf(table(spark, sf, "documents"), k=5)
