"""Registered queries: profiling and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .fixtures import view, with_views
from .registry import query
from .rounding import fround, sround as R

MON_MEASURES = ["year", "month", "volume_avg", "price_avg", "volume_sum", "price_sum"]
HIST_COLS = ["volume_avg", "price_avg", "volume_sum", "price_sum"]


def r(c, d=6):
    return fround(c, d)


def _unpivot_sql(cols, src):
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"(SELECT * FROM (UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} "
            f"INTO NAME col_name VALUE value) WHERE value IS NOT NULL)")


def _describe_sql(cols, src):
    return f"""
SELECT col_name, count(value) AS count, {R("CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / count(value)", 4)} AS mean,
       {R("stddev_samp(value)", 4)} AS std, {R("min(value)", 6)} AS min,
       {R("quantile_cont(value, 0.25)", 6)} AS q25, {R("quantile_cont(value, 0.5)", 6)} AS q50,
       {R("quantile_cont(value, 0.75)", 6)} AS q75, {R("max(value)", 6)} AS max
FROM {_unpivot_sql(cols, src)} u GROUP BY col_name"""


def _describe_out(df):
    return df.select("col_name", "count", r("mean", 4).alias("mean"), r("std", 4).alias("std"),
                     r("min").alias("min"), r("q25").alias("q25"), r("q50").alias("q50"),
                     r("q75").alias("q75"), r("max").alias("max"))


@query("d1_describe", with_views(_describe_sql(MON_MEASURES, "mon"), "mon"))
def d1_describe(spark, sf):
    return _describe_out(P.describe(view(spark, sf, "mon"), MON_MEASURES))


def _numeric_wide_cols():
    from ..operators.shape import INDEX_COLUMNS, WEATHER_COLUMNS
    return MON_MEASURES + INDEX_COLUMNS + WEATHER_COLUMNS + ["exceeding_loq"]


@query("d2_describe_all_numeric",
       with_views(_describe_sql(_numeric_wide_cols(), "mon_wide"), "mon_wide"))
def d2_describe_all(spark, sf):
    from pyspark.sql.types import NumericType
    df = view(spark, sf, "mon_wide").drop("origin_key")
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return _describe_out(P.describe(df, cols))


@query("d3_histogram", with_views(f"""
SELECT col_name, CAST(bin AS INTEGER) AS bin, {R("lo + bin * (hi - lo) / 10", 6)} AS bin_start,
       count(*) AS count
FROM (SELECT u.col_name, b.lo, b.hi,
             CASE WHEN b.hi = b.lo THEN 0
                  ELSE least(floor((value - b.lo) / ((b.hi - b.lo) / 10)), 9) END AS bin
      FROM {_unpivot_sql(HIST_COLS, 'mon')} u
      JOIN (SELECT col_name, min(value) AS lo, max(value) AS hi
            FROM {_unpivot_sql(HIST_COLS, 'mon')} v GROUP BY col_name) b
        ON b.col_name = u.col_name) x
GROUP BY col_name, bin, lo, hi""", "mon"))
def d3_histogram(spark, sf):
    h = P.histogram(view(spark, sf, "mon"), HIST_COLS, bins=10)
    return h.select("col_name", "bin", r("bin_start").alias("bin_start"), "count")


@query("d4_value_counts", with_views("""
SELECT origin_code3, count(*) AS count FROM mon WHERE origin_code3 IS NOT NULL
GROUP BY origin_code3""", "mon"))
def d4_value_counts(spark, sf):
    return P.value_counts(view(spark, sf, "mon"), "origin_code3")


@query("d5_group_size", with_views("""
SELECT year, exceeding_loq, count(*) AS count FROM mon
WHERE year IS NOT NULL AND exceeding_loq IS NOT NULL
GROUP BY year, exceeding_loq""", "mon"))
def d5_group_size(spark, sf):
    g = P.group_size(view(spark, sf, "mon"), ["year", "exceeding_loq"])
    return g.orderBy(F.desc_nulls_last("year"), "exceeding_loq")


@query("d6_group_size_three_keys", with_views(f"""
SELECT year, origin_code3, {R("volume_avg", 6)} AS volume_avg, count(*) AS count FROM mon
WHERE year IS NOT NULL AND origin_code3 IS NOT NULL AND volume_avg IS NOT NULL
GROUP BY year, origin_code3, volume_avg""", "mon"))
def d6_group_size3(spark, sf):
    g = P.group_size(view(spark, sf, "mon"), ["year", "origin_code3", "volume_avg"])
    return g.select("year", "origin_code3", r("volume_avg").alias("volume_avg"), "count")


@query("d6_group_size_price", with_views(f"""
SELECT year, origin_code3, {R("price_avg", 6)} AS price_avg, count(*) AS count FROM mon
WHERE year IS NOT NULL AND origin_code3 IS NOT NULL AND price_avg IS NOT NULL
GROUP BY year, origin_code3, price_avg""", "mon"))
def d6_group_size_price(spark, sf):
    g = P.group_size(view(spark, sf, "mon"), ["year", "origin_code3", "price_avg"])
    return g.select("year", "origin_code3", r("price_avg").alias("price_avg"), "count")


@query("d7_series_by_origin", with_views(f"""
SELECT origin_code3, {R("max(volume_avg)", 6)} AS max_volume_avg,
       {R("avg(volume_avg)", 6)} AS avg_volume_avg
FROM mon WHERE origin_code3 IS NOT NULL GROUP BY origin_code3""", "mon"))
def d7_series(spark, sf):
    s = P.series_by(view(spark, sf, "mon"), "origin_code3", "volume_avg")
    return s.select("origin_code3", r("max_volume_avg").alias("max_volume_avg"),
                    r("avg_volume_avg").alias("avg_volume_avg"))


@query("d8_class_ratio", with_views(f"""
SELECT CAST(count_if(exceeding_loq = 1) AS BIGINT) AS n_pos,
       CAST(count_if(exceeding_loq = 0) AS BIGINT) AS n_neg,
       {R("count_if(exceeding_loq = 1) / nullif(count_if(exceeding_loq = 0), 0)", 8)} AS pos_per_neg,
       {R("count_if(exceeding_loq = 0) / nullif(count_if(exceeding_loq = 1), 0)", 8)} AS neg_per_pos
FROM mon WHERE year < 2001""", "mon"))
def d8_class_ratio(spark, sf):
    m = view(spark, sf, "mon").where(F.col("year") < 2001)
    c = P.class_ratio(m, "exceeding_loq")
    return c.select("n_pos", "n_neg", r("pos_per_neg", 8).alias("pos_per_neg"),
                    r("neg_per_pos", 8).alias("neg_per_pos"))


@query("d9_class_frequencies", with_views("""
SELECT exceeding_loq, count(*) AS count FROM mon WHERE exceeding_loq IS NOT NULL
GROUP BY exceeding_loq""", "mon"))
def d9_class_freq(spark, sf):
    return P.class_frequencies(view(spark, sf, "mon"), "exceeding_loq")


@query("d20_trade_features", with_views(f"""
SELECT nk AS origin_key, yr AS year, mo AS month, {R("volume_avg", 6)} AS volume_avg,
       {R("volume_sum", 4)} AS volume_sum, {R("price_avg", 6)} AS price_avg,
       {R("price_sum", 4)} AS price_sum FROM trade""", "trade"))
def d20_trade(spark, sf):
    m = view(spark, sf, "mon")
    return (m.select("origin_key", "year", "month", r("volume_avg").alias("volume_avg"),
                     r("volume_sum", 4).alias("volume_sum"), r("price_avg").alias("price_avg"),
                     r("price_sum", 4).alias("price_sum")).distinct())


@query("d21_top_origins", with_views("""
SELECT coalesce(origin_code3, 'unknown') AS origin_code3, count(*) AS count FROM mon
GROUP BY 1 ORDER BY count DESC, origin_code3 LIMIT 3""", "mon"))
def d21_top_origins(spark, sf):
    return P.top_origins(view(spark, sf, "mon"), "origin_code3", 3)


@query("d22_year_coverage", with_views("""
SELECT CAST(y.year AS INTEGER) AS year, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM (SELECT unnest(generate_series((SELECT min(year) FROM mon), (SELECT max(year) FROM mon)))
             AS year) y
LEFT JOIN (SELECT year, count(*) AS count FROM mon WHERE year IS NOT NULL GROUP BY year) c
  ON c.year = y.year""", "mon"))
def d22_year_coverage(spark, sf):
    return P.year_coverage(view(spark, sf, "mon"))


@query("d23_outlier_share", with_views(f"""
SELECT {R("avg(CAST(topic = -1 AS DOUBLE))", 8)} AS outlier_share FROM topics""", "topics"))
def d23_outlier_share(spark, sf):
    return P.outlier_share(view(spark, sf, "topics")).select(
        r("outlier_share", 8).alias("outlier_share"))


# --- sorts, limits ---------------------------------------------------------

@query("h1_sort_desc", with_views(f"""
SELECT row_key, year, {R("volume_avg", 6)} AS volume_avg FROM mon
ORDER BY year DESC NULLS LAST, volume_avg DESC NULLS LAST, row_key""", "mon"))
def h1_sort_desc(spark, sf):
    m = view(spark, sf, "mon")
    return (m.select("row_key", "year", r("volume_avg").alias("volume_avg"))
             .orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("volume_avg"), "row_key"))


@query("h2_sorted_distinct_topics", with_views(
    "SELECT DISTINCT topic FROM topics ORDER BY topic", "topics"))
def h2_sorted_distinct(spark, sf):
    return view(spark, sf, "topics").select("topic").distinct().orderBy("topic")


@query("h3_head", with_views("""
SELECT row_key, exceeding_loq, hazard, year, month FROM mon ORDER BY row_key LIMIT 5""", "mon"))
def h3_head(spark, sf):
    return (view(spark, sf, "mon").select("row_key", "exceeding_loq", "hazard", "year", "month")
            .orderBy("row_key").limit(5))


@query("h4_truncated_text", """
SELECT doc_id, substr(text, 1, 500) AS preview FROM documents""")
def h4_truncated(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500)
                                               .alias("preview"))
