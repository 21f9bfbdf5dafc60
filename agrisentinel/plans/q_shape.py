"""Registered queries: projections, predicates, splits and weights
(B1–B18, M1, M3, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import shape as S
from ..sources.tables import table
from .fixtures import view, with_views
from .registry import query
from .rounding import fround, sround as R

B1_COLS = S.BASE_COLUMNS + [S.LABEL]
# Fixed values (must equal the reference's): the topic ids shown over time.
TOPIC_SUBSET = [0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14, 16, 20, 22, 23, 24, 25, 26, 27, 28]
RESUME_INDEX = 758      # fixed value: the reference's start index
HOLDOUT_YEAR = 2000     # last year of data is 2001 (partial); 2000 plays the held-out year
CUT_YEAR = 2001         # the data ends in 2001 where the reference's ends in 2021


def _sel(cols):
    return ", ".join(cols)


@query("b1_project", with_views(f"SELECT row_key, {_sel(B1_COLS)} FROM mon_wide", "mon_wide"))
def b1_project(spark, sf):
    return view(spark, sf, "mon_wide").select("row_key", *B1_COLS)


@query("b2_reorder", with_views(f"SELECT row_key, {_sel(S.DESIRED_ORDER)} FROM mon_wide",
                                "mon_wide"))
def b2_reorder(spark, sf):
    return S.reorder(view(spark, sf, "mon_wide"), keep=["row_key"])


@query("b3_column_family", with_views(
    "SELECT row_key, " + _sel([c for c in S.WEATHER_COLUMNS
                              if c.startswith("temperature_max_mean_")]) + " FROM mon_wide",
    "mon_wide"))
def b3_family(spark, sf):
    w = view(spark, sf, "mon_wide")
    return w.select("row_key", *S.family(w, "temperature_max", "mean").columns)


@query("b4_positional_slice", with_views(
    f"SELECT row_key, {_sel(S.DESIRED_ORDER[2:-1])}, {S.LABEL} AS y FROM mon_wide", "mon_wide"))
def b4_positional(spark, sf):
    w = S.reorder(view(spark, sf, "mon_wide"))
    feats = S.positional(w, 2, -1)
    label = w.columns[-1]
    return view(spark, sf, "mon_wide").select("row_key", *feats, F.col(label).alias("y"))


@query("b5_select_by_dtype", with_views(
    "SELECT row_key, hazard, origin_code3, notified_code3, continent FROM mon_wide",
    "mon_wide"))
def b5_by_dtype(spark, sf):
    w = S.reorder(view(spark, sf, "mon_wide"), keep=["row_key"])
    cats = [c for c in S.string_columns(w.select(*S.DESIRED_ORDER))]
    return w.select("row_key", *cats)


@query("b6_range_predicate", with_views(
    f"SELECT row_key, year, exceeding_loq FROM mon WHERE year < {CUT_YEAR}", "mon"))
def b6_range(spark, sf):
    return (view(spark, sf, "mon").where(F.col("year") < CUT_YEAR)
            .select("row_key", "year", "exceeding_loq"))


@query("b7_temporal_holdout", with_views(f"""
SELECT row_key, year, CASE WHEN year < {HOLDOUT_YEAR} THEN 'train' ELSE 'validate' END AS split
FROM mon WHERE year <= {HOLDOUT_YEAR}""", "mon"))
def b7_holdout(spark, sf):
    m = view(spark, sf, "mon")
    train = m.where(F.col("year") < HOLDOUT_YEAR).withColumn("split", F.lit("train"))
    valid = m.where(F.col("year") == HOLDOUT_YEAR).withColumn("split", F.lit("validate"))
    return train.unionByName(valid).select("row_key", "year", "split")


@query("b8_nonnull_text", """
SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def b8_nonnull(spark, sf):
    d = table(spark, sf, "documents")
    return (d.where(F.col("text").isNotNull() & (F.trim("text") != ""))
             .select("doc_id", "n_chars"))


@query("b9_falsy_key_filter", with_views("""
SELECT url, page_id, pos FROM links WHERE url IS NOT NULL AND url <> ''""", "links"))
def b9_falsy(spark, sf):
    lk = view(spark, sf, "links")
    return lk.where(F.col("url").isNotNull() & (F.col("url") != "")).select("url", "page_id", "pos")


@query("b10_content_type", with_views("""
SELECT page_id, content_type, contains(content_type, 'text/html') AS html_contains,
       starts_with(content_type, 'text/html') AS html_startswith FROM responses""",
                                      "responses"))
def b10_ctype(spark, sf):
    r = view(spark, sf, "responses")
    return r.select("page_id", "content_type",
                    F.col("content_type").contains("text/html").alias("html_contains"),
                    F.col("content_type").startswith("text/html").alias("html_startswith"))


@query("b11_http_status", with_views(
    "SELECT page_id, url FROM responses WHERE status = 200", "responses"))
def b11_status(spark, sf):
    return view(spark, sf, "responses").where(F.col("status") == 200).select("page_id", "url")


@query("b12_topic_filter", with_views(
    "SELECT doc_id, url FROM topics WHERE topic = 3", "topics"))
def b12_topic(spark, sf):
    return view(spark, sf, "topics").where(F.col("topic") == 3).select("doc_id", "url")


@query("b13_outlier_exclusion", with_views(
    "SELECT doc_id, topic FROM topics WHERE topic <> -1", "topics"))
def b13_outliers(spark, sf):
    return view(spark, sf, "topics").where(F.col("topic") != -1).select("doc_id", "topic")


@query("b14_topic_in_list", with_views(
    f"SELECT doc_id, topic FROM topics WHERE topic IN ({_sel(map(str, TOPIC_SUBSET))})",
    "topics"))
def b14_in_list(spark, sf):
    return (view(spark, sf, "topics").where(F.col("topic").isin(TOPIC_SUBSET))
            .select("doc_id", "topic"))


@query("b15_column_derivation", with_views("""
SELECT doc_id, topic, CASE WHEN topic = -1 THEN 'Outlier' ELSE 'Topic ' || CAST(topic AS VARCHAR) END
         AS label_text,
       CAST(year(ts) AS INTEGER) AS year, length(text) AS n_chars FROM topics""", "topics"))
def b15_derive(spark, sf):
    t = view(spark, sf, "topics")
    return t.withColumns({
        "label_text": F.when(F.col("topic") == -1, F.lit("Outlier"))
                       .otherwise(F.concat(F.lit("Topic "), F.col("topic").cast("string"))),
        "year": F.year("ts"),
        "n_chars": F.length("text").cast("bigint"),
    }).select("doc_id", "topic", "label_text", "year", "n_chars")


@query("b16_default_for_missing", """
SELECT d.doc_id, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic,
       coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def b16_default(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("toxic"),
        F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("b17_offset_resume", f"""
SELECT doc_id, n_chars FROM documents WHERE doc_id >= {RESUME_INDEX}""")
def b17_resume(spark, sf):
    # records carry their stored position (doc_id), so resuming is a pushed-down
    # filter instead of a global sort + offset
    return (table(spark, sf, "documents").where(F.col("doc_id") >= RESUME_INDEX)
            .select("doc_id", "n_chars"))


@query("b18_distinct_values", with_views("SELECT DISTINCT year FROM mon", "mon"))
def b18_distinct(spark, sf):
    return view(spark, sf, "mon").select("year").distinct()


# --- M1, M3, M4 --------------------------------------------------------------

SPLIT_SQL = "(('0x' || substr(md5(row_key), 1, 8))::BIGINT % 100 < 20)"


@query("m1_hash_split", with_views(f"SELECT row_key, {SPLIT_SQL} AS is_test FROM mon", "mon"))
def m1_split(spark, sf):
    return S.split_flag(view(spark, sf, "mon")).select("row_key", "is_test")


@query("m1_split_sizes", with_views(f"""
SELECT {SPLIT_SQL} AS is_test, count(*) AS n, CAST(count_if(exceeding_loq = 1) AS BIGINT) AS n_pos
FROM mon WHERE year < {CUT_YEAR} GROUP BY 1""", "mon"))
def m1_sizes(spark, sf):
    m = S.split_flag(view(spark, sf, "mon").where(F.col("year") < CUT_YEAR))
    return m.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col("exceeding_loq") == 1).alias("n_pos"))


@query("m3_fixed_class_weights", with_views("""
SELECT row_key, CAST(CASE WHEN exceeding_loq = 1 THEN 3 ELSE 1 END AS DOUBLE)
         AS weight FROM mon""", "mon"))
def m3_weights(spark, sf):
    return view(spark, sf, "mon").select("row_key", S.fixed_weights().alias("weight"))


@query("m4_balanced_class_weights", with_views(f"""
SELECT exceeding_loq, count(*) AS n_c,
       {R("(sum(count(*)) OVER ()) / ((count(*) OVER ()) * count(*))", 8)} AS weight
FROM mon WHERE year < {CUT_YEAR} AND NOT {SPLIT_SQL} GROUP BY exceeding_loq""", "mon"))
def m4_balanced(spark, sf):
    train = S.split_flag(view(spark, sf, "mon").where(F.col("year") < CUT_YEAR)) \
        .where(~F.col("is_test"))
    w = S.balanced_weights(train)
    return w.select("exceeding_loq", "n_c", fround("weight", 8).alias("weight"))


@query("a14_scrape_stamp", """
SELECT page_id, strftime(TIMESTAMP '2025-06-09 10:00:00', '%Y-%m-%d %H:%M:%S') AS scrape_date
FROM pages""")
def a14_stamp(spark, sf):
    # the run's clock is a parameter; tests pass a fixed instant
    ts = F.lit("2025-06-09 10:00:00").cast("timestamp_ntz")
    return table(spark, sf, "pages").select("page_id", T.stamp(ts).alias("scrape_date"))


@query("f7_record_position", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
FROM documents""")
def f7_position(spark, sf):
    # per-source positions from range-partitioned running counts: a source
    # holding most records is still split across tasks
    from ..operators.common import dense_order_ids
    d = table(spark, sf, "documents").select("doc_id", "source")
    return dense_order_ids(d, ["doc_id"], "pos", group=["source"])
