"""Registered queries: streaming jobs (K1–K7) and the batch twin of K3.

Each stream query lets the ``events`` table arrive in day ranges, as many files
each as the table has partitions, in a fresh folder under the shared checkpoint
directory.  After every range the stream runs with ``availableNow`` from the same
checkpoint, so a range is a micro-batch at least and each run is a restart; the sink
is read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters as CN
from ..session import scratch_path, store
from ..sources.tables import table
from ..streaming import jobs as J
from .registry import query

DAY_RANGES = [(1, 10), (11, 20), (21, 31)]


def _arrive(spark, sf, folder, days, name):
    """The events of a range of days land in ``folder``."""
    ev = table(spark, sf, "events").where(F.dayofmonth("ts").between(*days))
    ev.write.mode("overwrite").parquet(f"{folder}/{name}")


def _run(spark, sf, job, ranges=DAY_RANGES, max_files=None):
    """Let the ranges arrive one after the other; ``job(stream, out, checkpoint)`` runs after each."""
    folder, out, ck = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "ck"))
    for i, days in enumerate(ranges):
        _arrive(spark, sf, folder, days, f"f{i}")
        job(J.event_stream(spark, f"{folder}/*", max_files=max_files), out, ck)
    return out


def _append(transform):
    return lambda s, out, ck: J.run_available_now(transform(s), out, ck)


@query("k1_available_now_batches", """
SELECT event_id, 'http://u/' || CAST(user_id AS VARCHAR) AS url,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM events""")
def k1_available_now(spark, sf):
    # two files at most per micro-batch: several batches in each run
    out = _run(spark, sf, _append(lambda s: s.select("event_id", "url", "event_time")), max_files=2)
    return spark.read.parquet(out).select("event_id", "url", J.utc_text("event_time").alias("event_time"))


DISTINCT_URLS = "SELECT DISTINCT 'http://u/' || CAST(user_id AS VARCHAR) AS url FROM events"


@query("k2_stream_dedup_unbounded", DISTINCT_URLS)
def k2_dedup(spark, sf):
    out = _run(spark, sf, _append(lambda s: J.dedup_unbounded(s).select("url")))
    return spark.read.parquet(out).select("url")


@query("k2_stream_dedup_watermark", DISTINCT_URLS)
def k2_dedup_wm(spark, sf):
    out = _run(spark, sf, _append(lambda s: J.dedup_within_watermark(s, delay="60 days").select("url")))
    return spark.read.parquet(out).select("url")


@query("k3_window_counts", """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) AS n FROM events GROUP BY 1""")
def k3_batch(spark, sf):
    ev = table(spark, sf, "events")
    w = ev.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


WINDOWS_SQL = """
WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS ws, count(*) AS n FROM events {where} GROUP BY 1),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events {where})
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, n
FROM w, m WHERE ws + INTERVAL 6 HOUR <= wm"""


def _window_text(df):
    return df.select(J.utc_text("window_start").alias("window_start"),
                     J.utc_text("window_end").alias("window_end"), "n")


@query("k3_window_counts_stream", WINDOWS_SQL.format(where=""))
def k3_stream(spark, sf):
    # append mode: a window is emitted once the watermark (max event time
    # − 1 hour) passes its end, so the last, still open window is withheld
    return _window_text(spark.read.parquet(_run(spark, sf, _append(J.window_counts))))


@query("k4_late_data_watermark", WINDOWS_SQL.format(where="WHERE dayofmonth(ts) >= 21"))
def k4_late(spark, sf):
    # the last range arrives first, so the first two ranges are late for a
    # 1-hour watermark and their rows are dropped
    late_first = [DAY_RANGES[2], DAY_RANGES[0], DAY_RANGES[1]]
    return _window_text(spark.read.parquet(_run(spark, sf, _append(J.window_counts), late_first)))


@query("k5_stream_static_unseen", """
SELECT event_id, 'http://u/' || CAST(user_id AS VARCHAR) AS url FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')""")
def k5_unseen(spark, sf):
    ev = table(spark, sf, "events")
    # URLs known from an earlier run: users active in the first six hours
    seen = (ev.where(F.col("ts") < F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
              .select(F.concat(F.lit("http://u/"), F.col("user_id").cast("string")).alias("url"))
              .distinct())
    out = _run(spark, sf, _append(lambda s: J.unseen_stream(s, seen).select("event_id", "url")))
    return spark.read.parquet(out)


FIRST_PER_USER = """
SELECT url, event_id FROM (
  SELECT 'http://u/' || CAST(user_id AS VARCHAR) AS url, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t
WHERE rn = 1"""


@query("k6_restart_idempotent", FIRST_PER_USER)
def k6_restart(spark, sf):
    out = _run(spark, sf, J.first_per_key_sink)
    return J.first_per_key(spark, out).select("url", "event_id")


@query("k7_stream_keep_first", FIRST_PER_USER)
def k7_first(spark, sf):
    """Keyed state; the ranges arrive newest first, so most firsts are corrected."""
    out = _run(spark, sf, J.run_earliest, DAY_RANGES[::-1])
    return J.earliest_now(spark.read.schema(J.CHANGE).parquet(out)).select(F.col("key").alias("url"), "event_id")


@query("k7_first_changes", """
WITH b AS (
  SELECT 'http://u/' || CAST(user_id AS VARCHAR) AS url, CASE WHEN dayofmonth(ts) >= 21 THEN 0 WHEN dayofmonth(ts) >= 11 THEN 1
         ELSE 2 END AS run, min(struct_pack(at := ts, id := event_id)) AS e FROM events GROUP BY ALL),
s AS (SELECT url, run, e, min(e) OVER (PARTITION BY url ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
c AS (SELECT * FROM s WHERE p IS NULL OR e < p)
SELECT url, e.id AS event_id, CAST(row_number() OVER (PARTITION BY url ORDER BY run) - 1 AS INTEGER) AS version,
       CASE WHEN p IS NULL THEN 'first' ELSE 'correction' END AS change, p.id AS replaces FROM c""")
def k7_changes(spark, sf):
    """What the running stream told its readers: firsts and their corrections."""
    out = _run(spark, sf, J.run_earliest, DAY_RANGES[::-1])
    changes = spark.read.schema(J.CHANGE).parquet(out).where(F.col("change") != "settled")
    return changes.select(F.col("key").alias("url"), "event_id", "version", "change", "replaces")


@query("d18_daily_distinct", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events),
e AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, count(DISTINCT user_id) AS n_users FROM d GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, n, n_users, true AS within_bound FROM e""")
def d18_sketches(spark, sf):
    """Weekly distinct users from the stored daily sketches, beside the exact count and the stated error."""
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    week = F.date_format(F.to_date(F.date_trunc("week", "day")), "yyyy-MM-dd").alias("week")
    daily = store(CN.daily_sketches(ev, F.col("day"), "user_id"), "d18-sketches")
    exact = ev.groupBy(week).agg(F.count_distinct("user_id").alias("n_users"))
    off = F.abs(F.col("estimate") - F.col("n_users")) <= CN.error_bound() * F.col("n_users")
    return CN.merged_counts(daily, week).join(exact, "week").select("week", "n", "n_users", off.alias("within_bound"))


@query("d18_observed_write", """
SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id,
       count(*) FILTER (event_type = 'click') AS n_clicks FROM events""")
def d18_observed(spark, sf):
    """Figures that the write itself collected."""
    ev = table(spark, sf, "events")
    seen = CN.observed_write(ev, scratch_path(spark, "d18-events"), n=F.count(F.lit(1)), first_id=F.min("event_id"),
                             last_id=F.max("event_id"), n_clicks=F.count_if(F.col("event_type") == "click"))
    return spark.createDataFrame([(seen["n"], seen["first_id"], seen["last_id"], seen["n_clicks"])],
                                 "n long, first_id long, last_id long, n_clicks long")
