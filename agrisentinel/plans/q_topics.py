"""Registered queries: topic analytics on a given assignment (``topics``:
``embeddings.label`` as topic, 9 → −1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import terms as TM
from ..operators import topics as TP
from ..sources.tables import table
from .fixtures import view, with_views
from . import sqltext as Q
from .q_terms import COUNTS_SQL, CTFIDF_SQL
from .q_shape import TOPIC_SUBSET
from .registry import query
from .rounding import fround, sround as R

QUERY_VEC_ID = 7       # the query vector of G1 is this document's embedding
HEATMAP_TOP = 30       # fixed values (reference): heatmap / hierarchy / bars / time
HIERARCHY_TOP = 15
BARS_TOP = 40
NR_BINS = 40
REP_DOCS = 50
SAMPLE_N = 5

CENT = """SELECT topic, dim, avg(v) AS value FROM (
  SELECT topic, unnest(generate_series(0, len(embedding) - 1)) AS dim,
         unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS v FROM topics) x
GROUP BY topic, dim"""
NORMS = "SELECT topic, sqrt(sum(value * value)) AS norm FROM cent GROUP BY topic"
SIZES = "SELECT topic, count(*) AS count FROM topics GROUP BY topic"
TOPW = """SELECT topic, term, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term)
  AS rank FROM ctfidf"""
WORDS = "SELECT topic, list(term ORDER BY rank) AS words FROM topw WHERE rank <= 10 GROUP BY topic"
TERMS_CTES = {"counts": COUNTS_SQL, "ctfidf": CTFIDF_SQL, "topw": TOPW, "words": WORDS}


def _assign(spark, sf):
    return view(spark, sf, "topics")


def _cent(spark, sf):
    return TP.centroids(_assign(spark, sf))


def _scores(spark, sf):
    return TM.class_tfidf(TM.class_term_counts(_assign(spark, sf)))


def _top_words(spark, sf, k=10):
    return TM.top_terms(_scores(spark, sf), k)


@query("d13_topic_sizes", with_views(SIZES, "topics"))
def d13_sizes(spark, sf):
    return TP.topic_sizes(_assign(spark, sf))


@query("d14_topic_share", with_views(f"""
SELECT topic, count, {R("count / sum(count) OVER ()", 8)} AS share
FROM (SELECT topic, count(*) AS count FROM topics WHERE topic <> -1 GROUP BY topic) s""", "topics"))
def d14_share(spark, sf):
    s = TP.topic_share(_assign(spark, sf))
    return s.select("topic", "count", fround("share", 8).alias("share"))


@query("d15_topic_centroids", with_views(
    f"SELECT topic, CAST(dim AS INTEGER) AS dim, {R('value')} AS value FROM cent", "topics",
    extra={"cent": CENT}))
def d15_centroids(spark, sf):
    return _cent(spark, sf).select("topic", "dim", fround("value").alias("value"))


def _query_long(spark, sf):
    e = table(spark, sf, "embeddings").where(F.col("vec_id") == QUERY_VEC_ID)
    return TP.long_vectors(e, "vec_id").select("dim", "value")


@query("g1_query_top_topics", with_views(f"""
WITH q AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS dim,
                  unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id = {QUERY_VEC_ID}),
sim AS (SELECT c.topic, {R("sum(c.value * q.q) / (max(n.norm) * (SELECT sqrt(sum(q * q)) FROM q))", 8)}
               AS similarity
        FROM cent c JOIN q ON q.dim = c.dim JOIN norms n ON n.topic = c.topic
        WHERE c.topic <> -1 GROUP BY c.topic)
SELECT topic, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, topic) AS INTEGER) AS rank
FROM sim ORDER BY similarity DESC, topic LIMIT 5""", "topics", extra={"cent": CENT, "norms": NORMS}))
def g1_query(spark, sf):
    cent = _cent(spark, sf).where(F.col("topic") != -1)
    sim = TP.cosine_to_query(cent, _query_long(spark, sf))
    top = (sim.withColumn("similarity", fround("similarity", 8))
              .orderBy(F.desc("similarity"), "topic").limit(5))
    # ranks of a 5-row result: numbered on the already-limited rows
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("similarity"), "topic")).cast("int"))


def _pairs_sql(top_n, upper, self_pairs):
    cond = "a.topic < b.topic" if upper else ("TRUE" if self_pairs else "a.topic <> b.topic")
    val = (f"1 - sum(a.value * b.value) / (max(na.norm) * max(nb.norm))" if upper
           else "sum(a.value * b.value) / (max(na.norm) * max(nb.norm))")
    name = "distance" if upper else "similarity"
    return with_views(f"""
WITH top AS (SELECT topic FROM ({SIZES}) s WHERE topic <> -1 ORDER BY count DESC, topic LIMIT {top_n}),
c AS (SELECT * FROM cent WHERE topic IN (SELECT topic FROM top))
SELECT a.topic AS topic_a, b.topic AS topic_b, {R(val, 8)} AS {name}
FROM c a JOIN c b ON a.dim = b.dim JOIN norms na ON na.topic = a.topic JOIN norms nb ON nb.topic = b.topic
WHERE {cond} GROUP BY a.topic, b.topic""", "topics", extra={"cent": CENT, "norms": NORMS})


@query("g2_topic_similarity_matrix", _pairs_sql(HEATMAP_TOP, False, True))
def g2_matrix(spark, sf):
    a = _assign(spark, sf)
    top = TP.top_topics(TP.topic_sizes(a), HEATMAP_TOP)
    p = TP.pairwise_similarity(TP.centroids(a), top)
    return p.select("topic_a", "topic_b", fround("similarity", 8).alias("similarity"))


@query("c7_topic_pairs", _pairs_sql(HIERARCHY_TOP, True, False))
def c7_pairs(spark, sf):
    a = _assign(spark, sf)
    top = TP.top_topics(TP.topic_sizes(a), HIERARCHY_TOP)
    p = TP.pairwise_similarity(TP.centroids(a), top, upper_only=True)
    return p.select("topic_a", "topic_b", fround(1 - F.col("similarity"), 8).alias("distance"))


DOC_CENT_SQL = """
SELECT d.doc_id, d.topic,
       sum(d.x * c.value) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.value * c.value))) AS cosine,
       sqrt(sum((d.x - c.value) * (d.x - c.value))) AS euclidean
FROM (SELECT doc_id, topic, unnest(generate_series(0, len(embedding) - 1)) AS dim,
             unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS x FROM topics) d
JOIN cent c ON c.topic = d.topic AND c.dim = d.dim GROUP BY d.doc_id, d.topic"""


def _doc_cent(spark, sf):
    a = _assign(spark, sf)
    return TP.doc_to_centroid(a, TP.centroids(a))


@query("g3_cosine_doc_topic", with_views(
    f"SELECT doc_id, topic, {R('cosine')} AS cosine FROM dc", "topics",
    extra={"cent": CENT, "dc": DOC_CENT_SQL}))
def g3_cosine(spark, sf):
    return _doc_cent(spark, sf).select("doc_id", "topic", fround("cosine").alias("cosine"))


@query("g4_euclidean_doc_topic", with_views(
    f"SELECT doc_id, topic, {R('euclidean')} AS euclidean FROM dc", "topics",
    extra={"cent": CENT, "dc": DOC_CENT_SQL}))
def g4_euclid(spark, sf):
    return _doc_cent(spark, sf).select("doc_id", "topic", fround("euclidean").alias("euclidean"))


@query("j14_topic_assignment", with_views(
    f"SELECT doc_id, topic, {R('cosine')} AS probability FROM dc", "topics",
    extra={"cent": CENT, "dc": DOC_CENT_SQL}))
def j14_assign(spark, sf):
    return _doc_cent(spark, sf).select("doc_id", "topic", fround("cosine").alias("probability"))


@query("c2_docs_topics_join", with_views("""
SELECT d.doc_id, t.topic, d.lang, d.n_chars FROM documents d JOIN topics t ON t.doc_id = d.doc_id""",
                                         "topics"))
def c2_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.join(_assign(spark, sf).select("doc_id", "topic"), "doc_id")


@query("c3_topic_keywords_left", with_views("""
SELECT t.doc_id, t.topic,
       CASE WHEN t.topic = -1 THEN '' ELSE coalesce(array_to_string(w.words[1:5], ', '), '') END
         AS keywords
FROM topics t LEFT JOIN words w ON w.topic = t.topic""", "topics", extra=TERMS_CTES))
def c3_keywords(spark, sf):
    k = TP.topic_keywords(_assign(spark, sf), _top_words(spark, sf), 5)
    return k.select("doc_id", "topic", F.array_join("keywords", ", ").alias("keywords"))


REPDOCS_SQL = f"""
SELECT topic, string_agg(snippet, '; ' ORDER BY rank) AS rep_docs FROM (
  SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY doc_id, url) AS rank,
         translate(substr(text, 1, 50), chr(10) || chr(13), '  ') || ' (' || url || ')' AS snippet
  FROM (SELECT topic, text, url, min(doc_id) AS doc_id FROM topics WHERE topic <> -1
        GROUP BY topic, text, url) d) r
WHERE rank <= {REP_DOCS} GROUP BY topic"""


@query("j16_representative_docs", with_views(
    "SELECT s.topic, coalesce(r.rep_docs, 'None') AS rep_docs FROM (SELECT DISTINCT topic FROM topics "
    "WHERE topic <> -1) s LEFT JOIN rd r ON r.topic = s.topic", "topics", extra={"rd": REPDOCS_SQL}))
def j16_repdocs(spark, sf):
    a = _assign(spark, sf)
    return TP.rep_docs_text(a, a, REP_DOCS)


@query("c4_rep_docs_left_default", with_views(
    "SELECT s.topic, coalesce(r.rep_docs, 'None') AS rep_docs FROM (SELECT unnest(["
    + ", ".join(map(str, TOPIC_SUBSET)) + "]) AS topic) s LEFT JOIN rd r ON r.topic = s.topic",
    "topics", extra={"rd": REPDOCS_SQL}))
def c4_default(spark, sf):
    wanted = spark.createDataFrame([(t,) for t in TOPIC_SUBSET], "topic int")
    return TP.rep_docs_text(_assign(spark, sf), wanted, REP_DOCS)


@query("f2_first_docs_per_topic", with_views(f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, doc_id FROM (
  SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id, url) AS rank
  FROM (SELECT topic, text, url, min(doc_id) AS doc_id FROM topics WHERE topic <> -1
        GROUP BY topic, text, url) d) r WHERE rank <= {REP_DOCS}""", "topics"))
def f2_first_docs(spark, sf):
    return TP.representative_docs(_assign(spark, sf), REP_DOCS).select("topic", "rank", "doc_id")


@query("d17_string_aggregation", with_views(
    "SELECT topic, string_agg(term, '; ' ORDER BY rank) AS words FROM topw WHERE rank <= 10 "
    "GROUP BY topic", "topics", extra=TERMS_CTES))
def d17_agg(spark, sf):
    return TP.ordered_join(_top_words(spark, sf), ["topic"], "rank", "term", "; ", "words")


@query("f3_top_topics", with_views(
    f"SELECT topic, count FROM ({SIZES}) s WHERE topic <> -1 ORDER BY count DESC, topic "
    f"LIMIT {HIERARCHY_TOP}", "topics"))
def f3_top(spark, sf):
    return TP.top_topics(TP.topic_sizes(_assign(spark, sf)), HIERARCHY_TOP)


@query("f4_topic_ids_by_frequency", with_views("""
WITH c AS (SELECT doc_id, label AS cluster FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
s AS (SELECT cluster, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY cluster),
r AS (SELECT cluster, CAST(row_number() OVER (ORDER BY n DESC, cluster) - 1 AS INTEGER) AS topic FROM s)
SELECT c.doc_id, c.cluster, coalesce(r.topic, -1) AS topic FROM c LEFT JOIN r ON r.cluster = c.cluster"""))
def f4_ids(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                              F.col("label").alias("cluster"))
    d = table(spark, sf, "documents").select("doc_id")
    return TP.renumber_by_size(e.join(d, "doc_id")).select("doc_id", "cluster", "topic")


@query("h5_random_sample_per_topic", with_views(f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, doc_id FROM (
  SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY md5('42' || CAST(doc_id AS VARCHAR)))
    AS rank FROM topics) t WHERE rank <= {SAMPLE_N}""", "topics"))
def h5_sample(spark, sf):
    return TP.sample_docs(_assign(spark, sf), SAMPLE_N).select("topic", "rank", "doc_id")


LABEL_SQL = ("CASE WHEN s.topic = -1 THEN 'Outlier' ELSE 'Topic ' || CAST(s.topic AS VARCHAR) || ': ' "
             "|| array_to_string(coalesce(w.words, [])[1:3], ', ') END")


@query("i13_topic_label", with_views(
    f"SELECT s.topic, {LABEL_SQL} AS label FROM (SELECT DISTINCT topic FROM topics) s "
    "LEFT JOIN words w ON w.topic = s.topic", "topics", extra=TERMS_CTES))
def i13_label(spark, sf):
    a = _assign(spark, sf).select("topic").distinct()
    w = TP.words_array(_top_words(spark, sf), k=10)
    return a.join(w, "topic", "left").select("topic", T.topic_label("topic", "words").alias("label"))


@query("i14_topic_name", with_views(
    "SELECT w.topic, CAST(w.topic AS VARCHAR) || '_' || array_to_string(w.words[1:4], '_') AS name "
    "FROM words w", "topics", extra=TERMS_CTES))
def i14_name(spark, sf):
    w = TP.words_array(_top_words(spark, sf), k=10)
    return w.select("topic", T.topic_name("topic", "words").alias("name"))


@query("j18_topic_distribution", with_views(
    f"SELECT s.topic, s.count, {LABEL_SQL} AS label FROM ({SIZES}) s LEFT JOIN words w "
    "ON w.topic = s.topic", "topics", extra=TERMS_CTES))
def j18_dist(spark, sf):
    s = TP.topic_sizes(_assign(spark, sf))
    w = TP.words_array(_top_words(spark, sf), k=10)
    return s.join(w, "topic", "left").select("topic", "count",
                                             T.topic_label("topic", "words").alias("label"))


@query("j12_topic_word_bars", with_views(f"""
WITH top AS (SELECT topic FROM ({SIZES}) s WHERE topic <> -1 ORDER BY count DESC, topic LIMIT {BARS_TOP})
SELECT topic, CAST(rank AS INTEGER) AS rank, term, score FROM topw
WHERE rank <= 5 AND topic IN (SELECT topic FROM top)""", "topics", extra=TERMS_CTES))
def j12_bars(spark, sf):
    a = _assign(spark, sf)
    top = TP.top_topics(TP.topic_sizes(a), BARS_TOP)
    tw = TM.top_terms(_scores(spark, sf), 5).join(top.select("topic"), "topic", "left_semi")
    return tw.select("topic", "rank", "term", fround("score", 10).alias("score"))


@query("j9_topic_info", with_views(f"""
SELECT s.topic, s.count,
       CAST(s.topic AS VARCHAR) || '_' || array_to_string(coalesce(w.words, [])[1:4], '_') AS name,
       array_to_string(coalesce(w.words, []), ', ') AS representation
FROM ({SIZES}) s LEFT JOIN words w ON w.topic = s.topic""", "topics", extra=TERMS_CTES))
def j9_info(spark, sf):
    s = TP.topic_sizes(_assign(spark, sf))
    w = TP.words_array(_top_words(spark, sf), k=10)
    j = s.join(w, "topic", "left").withColumn(
        "words", F.coalesce("words", F.array().cast("array<string>")))
    return j.select("topic", "count", T.topic_name("topic", "words").alias("name"),
                    F.array_join("words", ", ").alias("representation"))


@query("j17_enriched_output", with_views(f"""
SELECT t.doc_id, t.url, t.topic AS assigned_topic, {R('dc.cosine')} AS topic_probability,
       CASE WHEN t.topic = -1 THEN '' ELSE coalesce(array_to_string(w.words[1:5], ', '), '') END
         AS topic_keywords
FROM topics t JOIN dc ON dc.doc_id = t.doc_id LEFT JOIN words w ON w.topic = t.topic""",
    "topics", extra={"cent": CENT, "dc": DOC_CENT_SQL, **TERMS_CTES}))
def j17_enriched(spark, sf):
    a = _assign(spark, sf)
    kw = TP.topic_keywords(a, _top_words(spark, sf), 5)
    dc = TP.doc_to_centroid(a, TP.centroids(a))
    return (a.select("doc_id", "url").join(dc, "doc_id").join(kw.drop("topic"), "doc_id")
             .select("doc_id", "url", F.col("topic").alias("assigned_topic"),
                     fround("cosine").alias("topic_probability"),
                     F.array_join("keywords", ", ").alias("topic_keywords")))


BINS_SQL = f"""
WITH x AS (SELECT *, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS ex FROM topics),
r AS (SELECT min(ex) AS lo, max(ex) AS hi FROM x)
SELECT x.*, CAST(least(greatest(ceil((ex - lo) / ((hi - lo) / {NR_BINS})) - 1, 0), {NR_BINS - 1})
       AS INTEGER) AS bin, lo, hi FROM x, r"""


@query("j13_time_bins_frequency", with_views(f"""
SELECT topic, bin, {R("CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * ((hi - lo) / "
                       + str(NR_BINS) + ") END", 3)} AS bin_start, count(*) AS frequency
FROM binned GROUP BY topic, bin, lo, hi""", "topics", extra={"binned": BINS_SQL}))
def j13_bins(spark, sf):
    b = TP.time_bins(_assign(spark, sf), nr_bins=NR_BINS)
    return (b.groupBy("topic", "bin", "bin_start").agg(F.count(F.lit(1)).alias("frequency"))
             .select("topic", "bin", fround("bin_start", 3).alias("bin_start"), "frequency"))


@query("f6_previous_bin_smoothing", with_views(f"""
SELECT topic, bin, frequency,
       {R("(frequency + coalesce(lag(frequency) OVER (PARTITION BY topic ORDER BY bin), frequency)) / 2.0", 6)}
         AS smoothed
FROM (SELECT topic, bin, count(*) AS frequency FROM binned GROUP BY topic, bin) f""", "topics",
    extra={"binned": BINS_SQL}))
def f6_smoothing(spark, sf):
    from pyspark.sql import Window
    b = TP.time_bins(_assign(spark, sf), nr_bins=NR_BINS)
    f = b.groupBy("topic", "bin").agg(F.count(F.lit(1)).alias("frequency"))
    w = Window.partitionBy("topic").orderBy("bin")
    prev = F.coalesce(F.lag("frequency").over(w), F.col("frequency"))
    return f.select("topic", "bin", "frequency",
                    fround((F.col("frequency") + prev) / 2.0).alias("smoothed"))


def _bin_counts(binned, cls_cols):
    return TM.doc_terms(binned, cls_cols).groupBy(*cls_cols, "term").agg(F.count(F.lit(1)).alias("n"))


GSCORE = """
SELECT n.topic, n.term, n.n / l.len * ln(1 + a.A / f.f) AS g, ln(1 + a.A / f.f) AS idf
FROM counts n JOIN (SELECT topic, sum(n) AS len FROM counts GROUP BY topic) l ON l.topic = n.topic
JOIN (SELECT term, sum(n) AS f FROM counts GROUP BY term) f ON f.term = n.term
CROSS JOIN (SELECT floor(avg(len)) AS A FROM (SELECT topic, sum(n) AS len FROM counts
            GROUP BY topic) x) a"""

OVER_TIME_SQL = f"""
WITH bc AS (SELECT topic, bin, term, count(*) AS n FROM ({Q.terms_cte('binned', 'topic, bin')}) o
            WHERE term IN (SELECT term FROM counts) GROUP BY topic, bin, term),
gidf AS (SELECT DISTINCT term, idf FROM gscore),
blen AS (SELECT topic, bin, sum(n) AS len FROM bc GROUP BY topic, bin),
sb AS (SELECT bc.topic, bc.bin, bc.term, bc.n / blen.len * gidf.idf AS s
       FROM bc JOIN blen ON blen.topic = bc.topic AND blen.bin = bc.bin JOIN gidf ON gidf.term = bc.term),
prev AS (SELECT topic, bin, lag(bin) OVER (PARTITION BY topic ORDER BY bin) AS prev_bin
         FROM (SELECT DISTINCT topic, bin FROM binned) d),
prv AS (SELECT p.topic, p.bin, sb.term, sb.s AS sp FROM prev p
        JOIN sb ON sb.topic = p.topic AND sb.bin = p.prev_bin WHERE p.prev_bin IS NOT NULL),
bothv AS (SELECT coalesce(c.topic, v.topic) AS topic, coalesce(c.bin, v.bin) AS bin,
                 coalesce(c.term, v.term) AS term, c.s, v.sp
          FROM sb c FULL OUTER JOIN prv v ON c.topic = v.topic AND c.bin = v.bin AND c.term = v.term),
evo AS (SELECT b.topic, b.bin, b.term,
               CASE WHEN p.prev_bin IS NULL THEN coalesce(b.s, CAST(0 AS DOUBLE))
                    ELSE (coalesce(b.s, CAST(0 AS DOUBLE)) + coalesce(b.sp, CAST(0 AS DOUBLE))) / 2 END AS s
        FROM bothv b JOIN prev p ON p.topic = b.topic AND p.bin = b.bin),
gtop AS (SELECT topic, term FROM (SELECT topic, term, row_number() OVER (PARTITION BY topic
           ORDER BY {R('g', 10)} DESC, term) AS rk FROM gscore) x WHERE rk <= 5),
extra AS (SELECT p.topic, p.bin, g.term, CAST(0 AS DOUBLE) AS s FROM prev p JOIN gtop g ON g.topic = p.topic),
cand AS (SELECT topic, bin, term, max(s) AS s FROM (SELECT * FROM evo UNION ALL SELECT * FROM extra) u
         GROUP BY topic, bin, term),
fin AS (SELECT c.topic, c.bin, c.term, (c.s + coalesce(g.g, CAST(0 AS DOUBLE))) / 2 AS s
        FROM cand c LEFT JOIN gscore g ON g.topic = c.topic AND g.term = c.term),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic, bin ORDER BY {R('s', 10)} DESC, term) AS rank
       FROM fin),
words AS (SELECT topic, bin, string_agg(term, ', ' ORDER BY rank) AS words FROM rk WHERE rank <= 5
          GROUP BY topic, bin),
freq AS (SELECT topic, bin, {R("CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * ((hi - lo) / "
                               + str(NR_BINS) + ") END", 3)} AS bin_start, count(*) AS frequency
         FROM binned GROUP BY topic, bin, lo, hi)
SELECT f.topic, f.bin, f.bin_start, f.frequency, w.words
FROM freq f LEFT JOIN words w ON w.topic = f.topic AND w.bin = f.bin"""


@query("j13_topics_over_time", with_views(OVER_TIME_SQL, "topics",
                                          extra={"counts": COUNTS_SQL, "gscore": GSCORE,
                                                 "binned": BINS_SQL}))
def j13_over_time(spark, sf):
    out = TP.topics_over_time(_assign(spark, sf), _scores(spark, sf), _bin_counts, NR_BINS)
    return out.select("topic", "bin", fround("bin_start", 3).alias("bin_start"), "frequency", "words")


@query("d16_max_topic_probability", f"""
SELECT vec_id, {R("list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
                  " / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))", 8)}
         AS max_probability
FROM embeddings""")
def d16_max_prob(spark, sf):
    # a probability vector per document (squared, normalised components of
    # its embedding) and its maximum; a scalar would pass through unchanged
    e = table(spark, sf, "embeddings")
    sq = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    total = F.aggregate(sq, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", fround(F.array_max(sq) / total, 8).alias("max_probability"))
