"""Topic analytics over an assignment table (doc → topic) (D13–D15, G1–G4,
J9, J12–J14, J16–J18, C3, C4, F2–F4, F6, H5).

Vectors are handled in long form ``(id, dim, value)``: centroids are a
``groupBy(topic, dim)`` average (partial aggregation), and a similarity is an
equi-join on ``dim`` followed by a sum.  Nothing pairs documents with each
other; only topic-level tables (bounded by the number of topics, further cut
by the report's ``top_n``) are paired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import store
from . import terms as TM
from .common import dense_order_ids, top_k_per_group


def long_vectors(df: DataFrame, id_col: str, vec: str = "embedding") -> DataFrame:
    """``(id, dim, value)`` from an array column."""
    return df.select(id_col, F.posexplode(vec).alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


def topic_sizes(assign: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents per topic (outliers included)."""
    return assign.groupBy(topic).agg(F.count(F.lit(1)).alias("count"))


def topic_share(assign: DataFrame, topic: str = "topic") -> DataFrame:
    """Share of each real topic among non-outlier documents; the total
    is a scalar subquery, not a window over all topics."""
    sizes = topic_sizes(assign.where(F.col(topic) != -1), topic)
    total = sizes.select(F.sum("count")).scalar()
    return sizes.withColumn("share", F.col("count") / total)


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "embedding",
                 out: str = "centroid") -> DataFrame:
    """Element-wise mean of an array column per key (``Summarizer.mean``:
    a partial aggregation with one d-wide buffer per key and task)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(*keys, array_to_vector(F.col(vec)).alias("_v"))
    return (v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
             .select(*keys, vector_to_array("_m").alias(out)))


def centroid_arrays_of(assign: DataFrame, topic: str = "topic", vec: str = "embedding") -> DataFrame:
    """``(topic, centroid array<double>)``."""
    return mean_vectors(assign, [topic], vec, "centroid")


def centroids(assign: DataFrame, topic: str = "topic", vec: str = "embedding",
              id_col: str = "doc_id") -> DataFrame:
    """Mean vector per topic, long form ``(topic, dim, value)`` (a
    topic-sized table, exploded after the aggregation)."""
    c = centroid_arrays_of(assign, topic, vec)
    return c.select(topic, F.posexplode("centroid").alias("dim", "value"))


def centroid_arrays(cent: DataFrame, topic: str = "topic") -> DataFrame:
    """Centroids as ``array<double>`` (dims in order; bounded by dimension)."""
    return cent.groupBy(topic).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))),
                    lambda s: s["value"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays (JVM higher-order functions, no explode)."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    """G4."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, x: acc + x))


def _norms(long: DataFrame, key: str) -> DataFrame:
    return long.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def cosine_to_query(cent: DataFrame, query_long: DataFrame, topic: str = "topic") -> DataFrame:
    """Cosine similarity of every centroid to one query vector
    (``dim, value``; one row per dimension, broadcast)."""
    q = F.broadcast(query_long.select("dim", F.col("value").alias("q")))
    qn = query_long.select(F.sqrt(F.sum(F.col("value") * F.col("value")))).scalar()
    dots = (cent.join(q, "dim").groupBy(topic)
                .agg(F.sum(F.col("value") * F.col("q")).alias("dot")))
    return (dots.join(_norms(cent, topic), topic)
                .select(topic, (F.col("dot") / (F.col("norm") * qn)).alias("similarity")))


def pairwise_similarity(cent: DataFrame, topics: DataFrame | None = None,
                        topic: str = "topic", include_self: bool = True,
                        upper_only: bool = False) -> DataFrame:
    """Cosine between topic centroids, restricted to ``topics`` (a
    bounded top-n list).  Equi-join on ``dim``; output ``topic_a, topic_b,
    similarity``."""
    c = cent if topics is None else cent.join(topics.select(topic), topic, "left_semi")
    a = c.select(F.col(topic).alias("topic_a"), "dim", F.col("value").alias("va"))
    b = c.select(F.col(topic).alias("topic_b"), "dim", F.col("value").alias("vb"))
    cond = F.col("topic_a") < F.col("topic_b") if upper_only else (
        F.lit(True) if include_self else F.col("topic_a") != F.col("topic_b"))
    dots = (a.join(b, "dim").where(cond).groupBy("topic_a", "topic_b")
              .agg(F.sum(F.col("va") * F.col("vb")).alias("dot")))
    n = _norms(c, topic)
    na = n.select(F.col(topic).alias("topic_a"), F.col("norm").alias("na"))
    nb = n.select(F.col(topic).alias("topic_b"), F.col("norm").alias("nb"))
    return (dots.join(na, "topic_a").join(nb, "topic_b")
                .select("topic_a", "topic_b",
                        (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity")))


def doc_to_centroid(assign: DataFrame, cent: DataFrame | None = None, topic: str = "topic",
                    vec: str = "embedding", id_col: str = "doc_id") -> DataFrame:
    """Each document against its own topic's centroid: cosine
    similarity and euclidean distance.  One row per document joins one row
    per topic (AQE broadcasts the centroid table from its measured size)."""
    ca = centroid_arrays_of(assign, topic, vec)
    x = F.transform(vec, lambda e: e.cast("double"))
    return (assign.select(id_col, topic, x.alias("_x")).join(ca, topic)
                  .select(id_col, topic, cosine(F.col("_x"), F.col("centroid")).alias("cosine"),
                          euclidean(F.col("_x"), F.col("centroid")).alias("euclidean")))


ASSIGN_CHUNK = 1 << 15


def assign_to_topics(vectors: DataFrame, cent: DataFrame, id_col: str = "doc_id", vec: str = "embedding",
                     topic: str = "topic") -> DataFrame:
    """``id_col, topic, similarity, runner_up, margin``: nearest topic of any vector.

    ``cent`` holds ``topic, centroid``.  Every vector meets every centroid, in blocks
    of vectors and of centroids, and its best two are kept; the similarity is the
    cosine, the margin its lead over the runner-up (both null with a single topic).
    Ties go to the smaller topic.  Rows whose vector is null, empty, of another width
    or not finite have no topic and are left out; repeated rows are assigned each.
    """
    from . import neighbours as NB

    topics = NB.prepare(cent, topic, "centroid", "cosine")
    docs = NB.prepare(vectors, id_col, vec, "cosine")
    asked = docs.rows.where(F.size("vec") == topics.width).select((-1 - F.col("row")).alias("row"), "vec")
    best = NB.against(topics, asked, 2, ASSIGN_CHUNK)
    near = best.groupBy("row").agg(*[F.max(F.when(F.col("rank") == r, F.struct("other_id", "d"))).alias(n)
                                     for r, n in ((1, "a"), (2, "b"))])
    return near.join(docs.rows.select((-1 - F.col("row")).alias("row"), "id"), "row").select(
        F.col("id").alias(id_col), F.col("a.other_id").alias(topic), (1 - F.col("a.d")).alias("similarity"),
        F.col("b.other_id").alias("runner_up"), (F.col("b.d") - F.col("a.d")).alias("margin"))


def leaf_order(merges: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """``topic, position``: leaves of the merge tree side by side.

    ``merges`` (``step, left, right``) and ``topics`` are the rows of a report (its
    top-n), so one task orders them.  Where two groups merge, that with the smaller
    least topic comes first; groups that nothing joins follow in the same order.
    """
    import pandas as pd

    kind = dict(topics.dtypes)[topic]
    rows = topics.select(F.lit(-1).cast("long").alias("step"), F.col(topic).cast("long").alias("l"), F.lit(None).cast("long").alias("r"))
    rows = rows.unionByName(merges.select(F.col("step").cast("long"), F.col("left").cast("long").alias("l"),
                                          F.col("right").cast("long").alias("r")))

    def order(part: pd.DataFrame) -> pd.DataFrame:
        group = {int(t): [int(t)] for t in part.loc[part.step < 0, "l"]}
        for m in part[part.step >= 0].sort_values("step").itertuples():
            a, b = sorted((group[int(m.l)], group[int(m.r)]), key=min)
            for t in (whole := a + b):
                group[t] = whole
        heads = sorted({min(g): g for g in group.values()}.items())
        return pd.DataFrame([(t, i) for i, t in enumerate(t for _, g in heads for t in g)], columns=[topic, "position"])

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(order, f"{topic} long, position int").select(
        F.col(topic).cast(kind).alias(topic), "position")


def top_topics(sizes: DataFrame, n: int, topic: str = "topic",
               exclude_outliers: bool = True) -> DataFrame:
    """the n largest topics (size desc, id asc): a top-n report."""
    s = sizes.where(F.col(topic) != -1) if exclude_outliers else sizes
    return s.orderBy(F.desc("count"), F.asc(topic)).limit(n)


def renumber_by_size(assign: DataFrame, cluster: str = "cluster",
                     topic: str = "topic") -> DataFrame:
    """topic ids by frequency: 0 = largest cluster; noise (−1) stays −1.
    Ranking runs on the cluster-size table with range-partitioned running
    counts, so no single task sees all clusters."""
    sizes = assign.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    ranked = dense_order_ids(sizes.withColumn("_neg", -F.col("_n")), ["_neg", cluster], "_id")
    ids = ranked.select(cluster, F.col("_id").cast("int").alias(topic))
    return (assign.join(ids, cluster, "left")
                  .withColumn(topic, F.coalesce(F.col(topic), F.lit(-1))))


def representative_docs(assign: DataFrame, k: int = 50, topic: str = "topic",
                        text: str = "text", url: str = "url", order: str = "doc_id",
                        snippet_chars: int = 50) -> DataFrame:
    """E4 → F2 → I12: first k distinct (document, url) per real topic in
    arrival order, with their snippets.

    Documents are compared by an md5 of their text, and only the snippet's
    prefix travels through the shuffle — never whole texts."""
    d = (assign.where(F.col(topic) != -1)
               .select(topic, url, order, F.md5(text).alias("_h"),
                       F.substring(text, 1, snippet_chars).alias("_head"))
               .groupBy(topic, url, "_h")
               .agg(F.min(F.struct(order, "_head")).alias("_f"))
               .select(topic, url, F.col("_f")[order].alias(order), F.col("_f._head").alias("_head")))
    top = top_k_per_group(d, [topic], [F.col(order), F.col(url)], k,
                          salt_key=[topic, order])
    return top.select(topic, "rank", order, T.snippet("_head", url, snippet_chars).alias("snippet"))


def ordered_join(df: DataFrame, group: Sequence[str], order: str, value: str,
                 sep: str, name: str) -> DataFrame:
    """Values of a bounded group joined in an explicit order."""
    return df.groupBy(*group).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]),
        sep).alias(name))


def rep_docs_text(assign: DataFrame, all_topics: DataFrame, k: int = 50,
                  topic: str = "topic") -> DataFrame:
    """``"snippet (url); …"`` per topic, ``"None"`` without docs."""
    rd = ordered_join(representative_docs(assign, k, topic), [topic], "rank", "snippet", "; ",
                      "rep_docs")
    return (all_topics.select(topic).where(F.col(topic) != -1).distinct()
            .join(rd, topic, "left")
            .select(topic, F.coalesce("rep_docs", F.lit("None")).alias("rep_docs")))


def words_array(top_words: DataFrame, topic: str = "topic", k: int | None = None) -> DataFrame:
    """``(topic, words)``: top words in rank order (bounded by k)."""
    tw = top_words if k is None else top_words.where(F.col("rank") <= k)
    return tw.groupBy(topic).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))


def topic_keywords(assign: DataFrame, top_words: DataFrame, k: int = 5,
                   topic: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """Each document's topic keywords; outliers and topics without words
    get an empty list.  The words table has one row per topic."""
    w = words_array(top_words, topic, k)
    return (assign.join(w, topic, "left")
                  .select(id_col, topic,
                          F.when(F.col(topic) == -1, F.array().cast("array<string>"))
                           .otherwise(F.coalesce("words", F.array().cast("array<string>")))
                          .alias("keywords")))


def sample_docs(assign: DataFrame, n: int = 5, seed: str = "42", topic: str = "topic",
                id_col: str = "doc_id") -> DataFrame:
    """H5: up to n documents per topic without replacement, in a seeded
    hash order (all of them when a topic has ≤ n)."""
    h = assign.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    return top_k_per_group(h, [topic], ["_h"], n, salt_key=[id_col]).drop("_h")


def vector_keyphrases(assign: DataFrame, k: int = 5, id_col: str = "doc_id", text: str = "text",
                      vec: str = "embedding") -> DataFrame:
    """Per document the k distinct words whose vectors (mean of the
    documents holding the word) are nearest to its own, joined by ``"; "``.

    The vectors of the ``COMMON_TERMS`` most frequent words are sent to every
    task, which scores them where the documents are; the occurrences of other
    words cross one shuffle, by word, with their document's vector.  Every row of
    a repeated id meets every vector of that id.
    """
    from ..plans.rounding import fround
    words = F.array_distinct(TM.drop_stop_words(TM.tokens(text)))
    as_double = F.transform(vec, lambda e: e.cast("double"))
    length = lambda v: F.sqrt(dot(v, v))
    docs = store(assign.where(F.col(id_col).isNotNull()).select(id_col, words.alias("_words"), F.col(vec).alias("x"), length(as_double).alias("_x")), "vector-words")
    once, again = TM.by_repeats(docs, id_col)
    occ = once.select(id_col, F.explode("_words").alias("term"), "x", "_x")
    if again is not None:
        occ = occ.unionByName(again.select(id_col, F.explode("_words").alias("term")).join(again.select(id_col, "x", "_x"), id_col))
    common = store(occ.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
                      .orderBy(F.desc("_n"), "term").limit(TM.COMMON_TERMS).select("term"), "vector-common")
    width = docs.agg(F.max(F.size("x"))).first()[0] or 0

    def means(rows):
        sums = [F.sum(F.get("x", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(width)]
        return (rows.groupBy("term").agg(F.count("x").alias("_n"), *sums)
                    .select("term", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(width)]).alias("w"))
                    .withColumn("_w", length(F.col("w"))))

    met = occ.join(F.broadcast(store(means(occ.join(F.broadcast(common), "term")), "vector-means")), "term")
    rare = occ.join(F.broadcast(common), "term", "left_anti").repartition("term")
    scored = met.unionByName(rare.join(means(rare), "term")).select(
        id_col, "term", fround(dot(F.col("w"), F.col("x")) / (F.col("_w") * F.col("_x")), 8).alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc("term"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ordered_join(top, [id_col], "rank", "term", "; ", "keyphrases")


# --- topics over time ------------------------------------------------------------

def time_bins(assign: DataFrame, ts: str = "ts", nr_bins: int = 40) -> DataFrame:
    """``nr_bins`` equal-width bins over the time range, right-closed,
    the first extended by 0.1 % of the range (``pd.cut``); ``bin_start`` is
    the bin's left edge in epoch seconds.  min/max are scalar subqueries."""
    epoch = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                   f"CAST({ts} AS TIMESTAMP_NTZ))").cast("double") / 1e6
    x = assign.withColumn("_x", epoch)
    lo = x.select(F.min("_x")).scalar()
    hi = x.select(F.max("_x")).scalar()
    width = (hi - lo) / nr_bins
    b = F.least(F.greatest(F.ceil((F.col("_x") - lo) / width) - 1, F.lit(0)), F.lit(nr_bins - 1))
    start = F.when(F.col("bin") == 0, lo - (hi - lo) * 0.001).otherwise(lo + F.col("bin") * width)
    return x.withColumn("bin", b.cast("int")).withColumn("bin_start", start).drop("_x")


def topics_over_time(assign: DataFrame, scores: DataFrame, counts_fn,
                     nr_bins: int = 40, top_n: int = 5, global_tuning: bool = True,
                     evolution_tuning: bool = True, topic: str = "topic") -> DataFrame:
    """J13 words per (topic, bin): c-TF-IDF of the bin's documents with the
    global idf; evolution tuning averages with the topic's previous bin,
    global tuning with the topic's global score.

    Only terms present in the bin or its predecessor can beat the topic's
    global top words among absent ones, so candidates are those plus the
    global top ``top_n`` — an exact reduction of the dense (term × bin) frame.
    ``counts_fn(df, cls_cols)`` returns ``(*cls_cols, term, n)``; terms without a
    score have no part.  The scored terms of a bin cross one shuffle, by topic and
    term, where each row also stands for the topic's next bin; the tables of
    topics and bins are small.
    """
    from ..plans.rounding import fround
    binned = time_bins(assign, nr_bins=nr_bins)
    freq = store(binned.groupBy(topic, "bin", "bin_start").agg(F.count(F.lit(1)).alias("frequency")), "over-time-bins")
    scores = store(scores.select(topic, "term", "score", "idf"), "over-time-scores")
    counts = store(counts_fn(binned, [topic, "bin"]).join(scores.select("term", "idf").distinct(), "term"), "over-time-counts")
    blen = counts.groupBy(topic, "bin").agg(F.sum("n").alias("_len"))
    w = Window.partitionBy(topic).orderBy("bin")
    around = freq.select(topic, "bin", F.lag("bin").over(w).isNotNull().alias("_late"), F.lead("bin").over(w).alias("_next"))
    sb = (counts.join(blen, [topic, "bin"]).join(around, [topic, "bin"])
                .select(topic, "bin", "term", (F.col("n") / F.col("_len") * F.col("idf")).alias("s"), "_late", "_next"))
    glob = scores.select(topic, "term", F.col("score").alias("g"))
    if global_tuning:
        gtop = top_k_per_group(glob.withColumn("_gr", fround("g", 10)), [topic],
                               [F.desc("_gr"), F.asc("term")], top_n,
                               salt_key=[topic, "term"]).select(topic, "term")
        sb = sb.unionByName(around.join(gtop, topic).select(
            topic, "bin", "term", F.lit(0.0).alias("s"), "_late", F.lit(None).cast("int").alias("_next")))
    sb = sb.repartition(topic, "term")
    if evolution_tuning:
        own = F.struct("bin", "s", F.lit(0.0).alias("sp"), "_late")
        following = F.struct(F.col("_next").alias("bin"), F.lit(0.0).alias("s"), F.col("s").alias("sp"), F.lit(True).alias("_late"))
        sb = (sb.select(topic, "term", F.explode(F.when(F.col("_next").isNull(), F.array(own)).otherwise(F.array(own, following))).alias("_r"))
                .groupBy(topic, "term", F.col("_r.bin").alias("bin"))
                .agg(F.sum("_r.s").alias("s"), F.sum("_r.sp").alias("sp"), F.max("_r._late").alias("_late"))
                .withColumn("s", F.when(F.col("_late"), (F.col("s") + F.col("sp")) / 2).otherwise(F.col("s"))))
    else:
        sb = sb.groupBy(topic, "term", "bin").agg(F.sum("s").alias("s"))
    if global_tuning:
        sb = sb.join(glob, [topic, "term"], "left").withColumn("s", (F.col("s") + F.coalesce("g", F.lit(0.0))) / 2)
    # tasks keep their best of each bin before bins are put together
    best = Window.partitionBy(topic, "bin").orderBy(F.desc("s"), F.asc("term"))
    ranked = (sb.select(topic, "bin", "term", fround("s", 10).alias("s"))
                .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n))
    words = ordered_join(ranked, [topic, "bin"], "rank", "term", ", ", "words")
    return freq.join(words, [topic, "bin"], "left")
