"""Registered queries: scans, sinks, link ingestion, de-duplication
(A1–A13, E1–E4, C5, C6).

File round trips write under the cluster's shared checkpoint folder (a fresh
path per call) and read back with explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import html as H
from ..operators import ingest as I
from ..session import scratch_path
from ..sources import files as FS
from ..sources.tables import table
from .fixtures import view, with_views
from .registry import query

MON_SCHEMA = ("row_key STRING, exceeding_loq INT, hazard STRING, year INT, month INT, "
              "origin_code3 STRING, notified_code3 STRING, volume_avg DOUBLE, price_avg DOUBLE, "
              "volume_sum DOUBLE, price_sum DOUBLE, continent STRING, origin_key INT")
LINK_SCHEMA = "url STRING, batch_seq INT, pos INT, page_id BIGINT"
ORDER = ["batch_seq", "page_id", "pos"]


@query("a1_csv_scan", with_views("SELECT * FROM mon", "mon"))
def a1_csv(spark, sf):
    path = scratch_path(spark, "a1-mon-csv")
    FS.write_csv(view(spark, sf, "mon"), path)
    return FS.read_csv(spark, path, MON_SCHEMA)


@query("a2_json_scan", with_views("SELECT * FROM links", "links"))
def a2_json(spark, sf):
    path = scratch_path(spark, "a2-links-json")
    FS.write_json(view(spark, sf, "links"), path)
    return FS.read_json(spark, path, LINK_SCHEMA)


@query("a3_directory_scan", with_views("""
SELECT batch_seq AS source_batch, count(*) AS n_links, count(DISTINCT url) AS n_urls
FROM links GROUP BY batch_seq""", "links"))
def a3_directory(spark, sf):
    base = scratch_path(spark, "a3-dir")
    lk = view(spark, sf, "links")
    # one CSV directory per batch, then a single glob scan over all of them
    FS.write_csv(lk, base, partition_by=["batch_seq"])
    df = FS.read_csv(spark, f"{base}/*/*.csv", "url STRING, pos INT, page_id BIGINT",
                     with_source=True)
    src = F.regexp_extract(F.col("_metadata.file_path"), r"batch_seq=(\d+)", 1).cast("int")
    return (df.withColumn("source_batch", src).groupBy("source_batch")
              .agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("url").alias("n_urls")))


@query("a4_required_columns", with_views("SELECT url, '2025-06-09' AS date FROM links", "links"))
def a4_required(spark, sf):
    path = scratch_path(spark, "a4-csv")
    lk = view(spark, sf, "links").select("url", F.lit("2025-06-09").alias("date"))
    FS.write_csv(lk, path)
    df = FS.read_csv(spark, path, "url STRING, date STRING")
    return FS.require_columns(df, ["url", "date"])


@query("a5_permissive_split", """
SELECT (SELECT count(*) FROM events) AS n_good, (SELECT count(*) FROM pages) AS n_corrupt""")
def a5_permissive(spark, sf):
    path = scratch_path(spark, "a5-jsonl")
    good_lines = table(spark, sf, "events").select(F.col("props").alias("value"))
    bad_lines = table(spark, sf, "pages").select(
        F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("value"))
    good_lines.unionByName(bad_lines).write.text(path)
    good, bad = FS.read_json_permissive(spark, path, StructType.fromDDL("k INT"))
    return good.agg(F.count(F.lit(1)).alias("n_good")).select(
        "n_good", bad.select(F.count(F.lit(1))).scalar().alias("n_corrupt"))


def _rss_docs(spark, sf):
    """One RSS document per fetched page: an item per link; every fifth item
    has no publication date.  Links are XML-escaped."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    base = F.lit("2025-06-09 00:00:00").cast("timestamp_ntz")

    def item(x, i):
        link = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                                   F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        ts = base + F.make_dt_interval(F.lit(0), F.lit(0), i * 7)
        date = F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
        pub = F.when(i % 5 == 4, F.lit("")).otherwise(
            F.concat(F.lit("<pubDate>"), date, F.lit("</pubDate>")))
        return F.concat(F.lit("<item><link>"), link, F.lit("</link>"), pub, F.lit("</item>"))

    body = F.array_join(F.transform(hrefs, item), "")
    return pages.select("page_id", F.concat(F.lit("<rss><channel>"), body,
                                            F.lit("</channel></rss>")).alias("xml"))


@query("a6_rss_parse", with_views("""
SELECT page_id, url,
       CASE WHEN pos % 5 = 4 THEN 'No date available'
            ELSE strftime(TIMESTAMP '2025-06-09 00:00:00' + pos * 7 * INTERVAL 1 MINUTE,
                          '%a, %d %b %Y %H:%M:%S') || ' GMT' END AS date,
       CASE WHEN pos % 5 = 4 THEN NULL
            ELSE strftime(TIMESTAMP '2025-06-09 00:00:00' + pos * 7 * INTERVAL 1 MINUTE,
                          '%Y-%m-%d %H:%M:%S') END AS published
FROM links""", "links"))
def a6_rss(spark, sf):
    from ..functions.text import parse_rss_date
    from ..streaming.jobs import utc_text
    items = FS.parse_rss(_rss_docs(spark, sf), "xml", keep=["page_id"])
    # the feed's dates carry their zone (GMT); print them as UTC wall clock
    return (items.withColumn("_p", parse_rss_date("date"))
                 .select("page_id", "url", "date", utc_text("_p").alias("published")))


@query("a7_link_extraction", with_views("SELECT page_id, pos, url FROM links", "links"))
def a7_links(spark, sf):
    return I.extract_links(table(spark, sf, "pages")).select(
        "page_id", F.col("pos").cast("int").alias("pos"), "url")


def _container_sql(tag):
    return f"""
SELECT page_id, '{tag}' AS selector, CAST(i AS INTEGER) AS pos, regexp_extract(c, '<a\\s[^>]*href="([^"]*)"', 1) AS url
FROM (SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS c
      FROM (SELECT page_id, regexp_extract_all(html, '(?s)<{tag}\\b.*?</{tag}>') AS l FROM pages))
WHERE regexp_matches(c, '<a\\s[^>]*href="')"""


@query("a7_container_links", f"{_container_sql('li')} UNION ALL {_container_sql('nav')}")
def a7_containers(spark, sf):
    """The first link of each listing item, and of each listing as a whole."""
    pages = table(spark, sf, "pages")
    found = [H.container_links(pages, s).select("page_id", F.lit(s).alias("selector"), "pos", "url") for s in ("li", "nav")]
    return found[0].unionByName(found[1])


@query("a8_paginate_until_empty", with_views("""
SELECT session, page_num, n_links FROM (
  SELECT *, min(n_links) OVER (PARTITION BY session ORDER BY page_num
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m
  FROM page_counts WHERE page_num <= 5) t
WHERE m > 0""", "page_counts"))
def a8_paginate(spark, sf):
    return I.paginate_until_empty(view(spark, sf, "page_counts"), limit=5)


@query("a9_success_error_split", with_views(f"""
SELECT page_id, CASE WHEN status <> 200 THEN 'errors'
                     WHEN NOT contains(content_type, 'text/html') THEN 'errors'
                     ELSE 'results' END AS sink,
       CASE WHEN status <> 200 THEN 'HTTP error ' || CAST(status AS VARCHAR)
            WHEN NOT contains(content_type, 'text/html') THEN 'Non-HTML content: ' || content_type
            END AS error,
       CASE WHEN status = 200 AND contains(content_type, 'text/html')
            THEN {H.html_text_regex_sql('html')} END AS content
FROM responses""", "responses"))
def a9_split(spark, sf):
    r = view(spark, sf, "responses")
    ok, bad = I.split_outcomes(r, H.fetch_outcome("status", "content_type", "html"))
    return (ok.select("page_id", F.lit("results").alias("sink"),
                      F.lit(None).cast("string").alias("error"), "content")
              .unionByName(bad.select("page_id", F.lit("errors").alias("sink"), "error",
                                      F.lit(None).cast("string").alias("content"))))


@query("a10_json_sink", with_views("SELECT doc_id, topic, url FROM topics", "topics"))
def a10_json_sink(spark, sf):
    path = scratch_path(spark, "a10-json")
    FS.write_json(view(spark, sf, "topics").select("doc_id", "topic", "url"), path)
    return FS.read_json(spark, path, "doc_id BIGINT, topic INT, url STRING")


@query("a11_csv_sink", with_views("""
SELECT doc_id, array_to_string(string_split(url, '/'), '; ') AS parts FROM topics""", "topics"))
def a11_csv_sink(spark, sf):
    path = scratch_path(spark, "a11-csv")
    t = view(spark, sf, "topics").select("doc_id", F.split("url", "/").alias("parts"))
    FS.write_csv(t, path)
    return FS.read_csv(spark, path, "doc_id BIGINT, parts STRING").na.fill({"parts": ""})


@query("a12_dated_partitioned_output", with_views("""
SELECT '20250609' AS run_date, 'batch_' || CAST(batch_seq AS VARCHAR) AS source_file,
       count(*) AS n FROM links GROUP BY batch_seq""", "links"))
def a12_dated(spark, sf):
    path = scratch_path(spark, "a12-out")
    lk = view(spark, sf, "links").withColumn(
        "source_file", F.concat(F.lit("batch_"), F.col("batch_seq").cast("string")))
    FS.write_dated(lk.drop("batch_seq"), path, "20250609")
    back = spark.read.schema("url STRING, pos INT, page_id BIGINT, run_date STRING, "
                             "source_file STRING").json(path)
    return back.groupBy("run_date", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query("a13_incremental_append", with_views("""
SELECT url FROM seen
UNION ALL
SELECT url FROM (SELECT DISTINCT url FROM links WHERE batch_seq > 0 AND url IS NOT NULL AND url <> '')
WHERE url NOT IN (SELECT url FROM seen)""", "links", "seen"))
def a13_append(spark, sf):
    path = scratch_path(spark, "a13-store")
    lk = view(spark, sf, "links")
    lk.where(F.col("batch_seq") == 0).select("url").distinct().write.parquet(path)
    store = spark.read.parquet(path)
    fresh = I.merge_append(store, lk.where(F.col("batch_seq") > 0), "url", ORDER)
    fresh.select("url").write.mode("append").parquet(path)
    return spark.read.parquet(path)


# --- de-duplication and membership ------------------------------------------------

KEEP_FIRST_SQL = """
SELECT url, batch_seq, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY batch_seq, page_id, pos) AS rn
  FROM links WHERE url IS NOT NULL AND url <> '' {where}) t WHERE rn = 1"""


@query("e1_union_keep_first", with_views(KEEP_FIRST_SQL.format(where=""), "links"))
def e1_keep_first(spark, sf):
    lk = view(spark, sf, "links")
    batches = [lk.where(F.col("batch_seq") == b) for b in (0, 1, 2)]
    allb = batches[0].unionByName(batches[1]).unionByName(batches[2])
    return I.keep_first(allb, "url", ORDER).select("url", *ORDER)


@query("e2_in_batch_keep_first", with_views(
    KEEP_FIRST_SQL.format(where="AND batch_seq = 1"), "links"))
def e2_in_batch(spark, sf):
    lk = view(spark, sf, "links").where(F.col("batch_seq") == 1)
    return I.keep_first(lk, "url", ORDER).select("url", *ORDER)


@query("e3_set_difference", with_views(
    "SELECT * FROM (" + KEEP_FIRST_SQL.format(where="AND batch_seq > 0") +
    ") k WHERE url NOT IN (SELECT url FROM seen)", "links", "seen"))
def e3_difference(spark, sf):
    lk = view(spark, sf, "links")
    return I.new_unique(lk.where(F.col("batch_seq") > 0), view(spark, sf, "seen"), "url",
                        ORDER).select("url", *ORDER)


@query("e4_distinct_pairs", with_views("""
SELECT DISTINCT topic, md5(text) AS text_md5, url FROM topics""", "topics"))
def e4_distinct(spark, sf):
    t = view(spark, sf, "topics").select("topic", F.md5("text").alias("text_md5"), "url")
    return I.distinct_pairs(t, ["topic", "text_md5", "url"])


@query("c5_unseen_anti_join", with_views("""
SELECT url, page_id, pos FROM links l WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.url = l.url)""",
                                         "links", "seen"))
def c5_anti(spark, sf):
    return I.unseen(view(spark, sf, "links"), view(spark, sf, "seen")).select("url", "page_id", "pos")


@query("c6_seen_semi_join", with_views("""
SELECT url, page_id, pos FROM links l WHERE EXISTS (SELECT 1 FROM seen s WHERE s.url = l.url)""",
                                       "links", "seen"))
def c6_semi(spark, sf):
    return I.known(view(spark, sf, "links"), view(spark, sf, "seen")).select("url", "page_id", "pos")


@query("f5_running_stop_condition", with_views("""
SELECT session, page_num, n_links,
       min(n_links) OVER (PARTITION BY session ORDER BY page_num
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_min
FROM page_counts WHERE page_num <= 5""", "page_counts"))
def f5_running(spark, sf):
    from pyspark.sql import Window
    pc = view(spark, sf, "page_counts").where(F.col("page_num") <= 5)
    w = (Window.partitionBy("session").orderBy("page_num")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pc.withColumn("running_min", F.min("n_links").over(w))


@query("d18_counters", with_views("""
SELECT (SELECT count(*) FROM pages) AS n_pages, (SELECT count(*) FROM links) AS n_links,
       (SELECT count(DISTINCT url) FROM links) AS n_unique_urls,
       (SELECT count(DISTINCT topic) FROM topics WHERE topic <> -1) AS n_topics""",
                                  "links", "topics"))
def d18_counters(spark, sf):
    lk = view(spark, sf, "links")
    n_pages = table(spark, sf, "pages").select(F.count(F.lit(1))).scalar()
    n_topics = (view(spark, sf, "topics").where(F.col("topic") != -1)
                .select(F.count_distinct("topic")).scalar())
    return lk.agg(F.count(F.lit(1)).alias("n_links"),
                  F.count_distinct("url").alias("n_unique_urls")).select(
        n_pages.alias("n_pages"), "n_links", "n_unique_urls", n_topics.alias("n_topics"))
