"""Derived inputs built by Spark from the driver tables, each with its DuckDB twin.

The reference ships no data; these views give its operators realistic inputs
whose size grows with the given tables:

* ``mon``          monitoring-shaped records (one per ``lineitem`` row)
* ``mon_wide``     ``mon`` plus the 120-column weather family
* ``topics``       documents with a given topic (``embeddings.label``)
* ``links``        hrefs of every fetched page, with batch and position
* ``seen``         links already known before the current run
* ``page_counts``  one row per listing page: session, page number, links
* ``responses``    fetched pages with HTTP status and content type
* ``scored``       a predictions table: label, score, prediction

``SQL[name]`` is the same view in DuckDB's dialect; ``with_views`` prefixes a
query with the CTEs it needs, dependencies first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..operators.shape import INDEX_COLUMNS, WEATHER_COLUMNS, weather_value_expr_sql

# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------

HREF_PATTERN = r'<a\s[^>]*href="([^"]*)"'


def _money_stats(col: str, name: str):
    """avg and sum of a 2-decimal measure, summed exactly as DECIMAL so every
    engine (and every partitioning) yields the same double."""
    total = F.sum(F.col(col).cast("decimal(18,2)")).cast("double")
    return [(total / F.count(col)).alias(f"{name}_avg"), total.alias(f"{name}_sum")]


def mon(spark: SparkSession, sf: str) -> DataFrame:
    """Monitoring records: lineitem ⋈ orders ⋈ customer ⋈ part ⋈ supplier ⋈
    nation ×2 ⋈ region, plus per (origin, year, month) trade aggregates.

    The trade aggregate is a partial (map-side) aggregation whose output is
    bounded by nations × months and is broadcast back; nation and region are
    fixed-size dimensions.  orders, customer and part are left to AQE
    (broadcast when measured small, sort-merge otherwise).
    """
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    base = (li.join(sup, li.l_suppkey == sup.s_suppkey)
              .withColumn("year", F.year("l_shipdate"))
              .withColumn("month", F.month("l_shipdate")))
    trade = (base.groupBy(F.col("s_nationkey").alias("nk"), F.col("year").alias("yr"),
                          F.col("month").alias("mo"))
                 .agg(*_money_stats("l_quantity", "volume"),
                      *_money_stats("l_extendedprice", "price")))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    sn = F.broadcast(nation.select(F.col("n_nationkey").alias("sn_key"),
                                   F.col("n_name").alias("origin_code3"),
                                   F.col("n_regionkey").alias("sn_region")))
    cn = F.broadcast(nation.select(F.col("n_nationkey").alias("cn_key"),
                                   F.col("n_name").alias("notified_code3")))
    out = (base
           .join(orders, base.l_orderkey == orders.o_orderkey)
           .join(cust, F.col("o_custkey") == F.col("c_custkey"))
           .join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(sn, F.col("s_nationkey") == F.col("sn_key"))
           .join(cn, F.col("c_nationkey") == F.col("cn_key"))
           .join(F.broadcast(region), F.col("sn_region") == F.col("r_regionkey"))
           # one row per (origin nation, year, month): bounded by the fixed
           # nation dimension × months, so it is broadcast and the big side
           # is never shuffled on these low-cardinality (skew-prone) keys
           .join(F.broadcast(trade), (F.col("nk") == F.col("s_nationkey"))
                 & (F.col("yr") == F.col("year")) & (F.col("mo") == F.col("month"))))
    return out.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.to_date("l_shipdate").cast("string")).alias("row_key"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exceeding_loq"),
        F.col("p_type").alias("hazard"),
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        "origin_code3", "notified_code3",
        "volume_avg", "price_avg", "volume_sum", "price_sum",
        F.col("r_name").alias("continent"),
        F.col("s_nationkey").alias("origin_key"),
    )


def mon_wide(spark: SparkSession, sf: str) -> DataFrame:
    """``mon`` + 120 weather columns computed from month and origin country."""
    m = mon(spark, sf)
    return m.withColumns({name: F.expr(weather_value_expr_sql(name))
                          for name in INDEX_COLUMNS + WEATHER_COLUMNS})


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a given topic: label 9 plays the outlier class (−1)."""
    emb = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ev = table(spark, sf, "events").select(F.col("event_id"), F.col("ts"))
    return (emb.join(docs, emb.vec_id == docs.doc_id)
               .join(ev, F.col("doc_id") == F.col("event_id"), "left")
               .select("doc_id",
                       F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label"))
                        .alias("topic"),
                       "text",
                       F.concat(F.lit("http://doc/"), F.col("doc_id").cast("string")).alias("url"),
                       "ts", "embedding"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per href of every page; ``pos`` restarts on each page."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    return (pages.select("page_id",
                         F.posexplode(F.regexp_extract_all("html", F.lit(HREF_PATTERN), 1)))
                 .select(F.col("col").alias("url"),
                         (F.col("page_id") % 3).cast("int").alias("batch_seq"),
                         F.col("pos").cast("int").alias("pos"),
                         "page_id"))


def seen(spark: SparkSession, sf: str) -> DataFrame:
    return (links(spark, sf).where(F.col("batch_seq") == 0)
                            .select("url").distinct())


def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages of sessions of ten; a page id ending in 7 came back empty."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    n = F.size(F.regexp_extract_all("html", F.lit(HREF_PATTERN), 1))
    return pages.select(
        (F.col("page_id") / 10).cast("bigint").alias("session"),
        (F.col("page_id") % 10 + 1).alias("page_num"),
        F.when(F.col("page_id") % 10 == 7, F.lit(0)).otherwise(n).cast("int").alias("n_links"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages with the HTTP facts the reference's fetch step tests:
    blocked hosts answer 403; feed links declare an RSS content type; ``.html``
    paths a bare one; the rest a charset-qualified one with a leading space."""
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select(
        "page_id", "url", "html",
        F.when(host.rlike(r"^(spam-farm|www\.cheap-pills)\."), F.lit(403))
         .otherwise(F.lit(200)).alias("status"),
        F.when(F.col("url").contains("utm_source=feed"), F.lit("application/rss+xml"))
         .when(F.col("url").endswith(".html"), F.lit("text/html"))
         .otherwise(F.lit(" text/html; charset=utf-8")).alias("content_type"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("double").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") > 2000).cast("double").alias("prediction"))


BUILDERS = {
    "mon": mon, "mon_wide": mon_wide, "topics": topics, "links": links,
    "seen": seen, "page_counts": page_counts, "responses": responses, "scored": scored,
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf)


# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------

def _mon_wide_sql() -> str:
    cols = ",\n  ".join(f"{weather_value_expr_sql(n)} AS {n}" for n in INDEX_COLUMNS + WEATHER_COLUMNS)
    return f"SELECT mon.*,\n  {cols}\nFROM mon"


SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "trade": ("""
SELECT s.s_nationkey AS nk, CAST(year(l_shipdate) AS INTEGER) AS yr,
       CAST(month(l_shipdate) AS INTEGER) AS mo,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS volume_avg,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume_sum,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice)
         AS price_avg,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price_sum
FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey GROUP BY 1, 2, 3""", ()),
    "mon": ("""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS row_key,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exceeding_loq,
       p_type AS hazard, CAST(year(l_shipdate) AS INTEGER) AS year,
       CAST(month(l_shipdate) AS INTEGER) AS month,
       sn.n_name AS origin_code3, cn.n_name AS notified_code3,
       volume_avg, price_avg, volume_sum, price_sum, r_name AS continent,
       supplier.s_nationkey AS origin_key
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = l_partkey     JOIN supplier ON supplier.s_suppkey = l_suppkey
JOIN nation sn ON sn.n_nationkey = supplier.s_nationkey
JOIN nation cn ON cn.n_nationkey = c_nationkey
JOIN region ON r_regionkey = sn.n_regionkey
JOIN trade ON nk = supplier.s_nationkey AND yr = year(l_shipdate) AND mo = month(l_shipdate)""",
            ("trade",)),
    "mon_wide": (_mon_wide_sql(), ("mon",)),
    "topics": ("""
SELECT d.doc_id, CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS topic, d.text,
       'http://doc/' || CAST(d.doc_id AS VARCHAR) AS url, ev.ts AS ts, e.embedding
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
LEFT JOIN events ev ON ev.event_id = d.doc_id""", ()),
    "links": ("""
SELECT url, CAST(page_id % 3 AS INTEGER) AS batch_seq, CAST(pos AS INTEGER) AS pos, page_id
FROM (SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS url
      FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS l
            FROM pages) x) y""", ()),
    "seen": ("SELECT DISTINCT url FROM links WHERE batch_seq = 0", ("links",)),
    "page_counts": ("""
SELECT CAST(page_id // 10 AS BIGINT) AS session, page_id % 10 + 1 AS page_num,
       CAST(CASE WHEN page_id % 10 = 7 THEN 0
            ELSE len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) END AS INTEGER)
         AS n_links
FROM pages""", ()),
    "responses": ("""
SELECT page_id, url, html,
       CASE WHEN regexp_matches(regexp_extract(url, '^https?://([^/]+)', 1),
                                '^(spam-farm|www\\.cheap-pills)\\.') THEN 403 ELSE 200 END AS status,
       CASE WHEN contains(url, 'utm_source=feed') THEN 'application/rss+xml'
            WHEN ends_with(url, '.html') THEN 'text/html'
            ELSE ' text/html; charset=utf-8' END AS content_type
FROM pages""", ()),
    "scored": ("""
SELECT l.doc_id, CAST(toxic AS DOUBLE) AS label, CAST(n_chars AS DOUBLE) AS score,
       CAST(n_chars > 2000 AS DOUBLE) AS prediction
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""", ()),
}


def with_views(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding ``names`` (and their dependencies) + query.

    ``extra`` adds ad-hoc CTEs (name → SQL) after the fixtures, in order.
    """
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in SQL[n][1]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL[n][0]}\n)" for n in ordered]
    parts += [f"{k} AS ({v}\n)" for k, v in (extra or {}).items()]
    if not parts:
        return query
    body = query.lstrip()
    if body[:4].upper() == "WITH":
        # merge the query's own CTEs after ours
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + query
