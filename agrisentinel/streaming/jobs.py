"""Structured Streaming versions of the incremental jobs (K1–K7).

The reference polls a feed once a day and keeps its state in the output file.
Here new inputs are files landing in a directory; each run is an
``availableNow`` trigger (the schedule lives outside Spark), state lives in
the checkpoint (shared storage), and sinks are idempotent per batch id, so a
lost executor or a restarted run neither loses nor duplicates output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import keep_first

EVENT_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                "value DOUBLE, props STRING")


def event_stream(spark: SparkSession, directory: str, schema: str = EVENT_SCHEMA,
                 max_files: int | None = None) -> DataFrame:
    """K1 source: parquet files in ``directory``; ``ts`` (wall clock, UTC)
    becomes ``event_time`` TIMESTAMP (watermarks need it) and ``url`` is the
    record key."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(directory)
    # the wall clock of ts read as UTC, whatever the session zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return (s.withColumn("event_time", F.timestamp_micros(micros))
             .withColumn("url", F.concat(F.lit("http://u/"), F.col("user_id").cast("string"))))


def utc_text(col: str, fmt: str = "yyyy-MM-dd HH:mm:ss"):
    """A timestamp's UTC wall clock as text (independent of the session zone)."""
    ntz = F.expr(f"timestampadd(MICROSECOND, unix_micros({col}), "
                 f"TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return F.date_format(ntz, fmt)


def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      partition_by: Sequence[str] = ()) -> None:
    """K1: process everything that has arrived, then stop (parquet sink)."""
    w = (df.writeStream.format("parquet").option("path", path)
           .option("checkpointLocation", checkpoint).outputMode(mode)
           .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


def dedup_unbounded(stream: DataFrame, key: str = "url") -> DataFrame:
    """K2: first-seen per key, state kept for ever (the reference's `seen`)."""
    return stream.dropDuplicates([key])


def dedup_within_watermark(stream: DataFrame, key: str = "url", delay: str = "30 days") -> DataFrame:
    """K2 bounded: duplicates within ``delay`` of event time are dropped and
    state older than the watermark is evicted."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, every: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """K3/K4: tumbling windows with a watermark; late rows beyond ``delay``
    are dropped, a window is emitted once the watermark passes its end."""
    return (stream.withWatermark("event_time", delay)
                  .groupBy(F.window("event_time", every).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "n"))


def unseen_stream(stream: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """K5: stream-static anti join (the static side is re-read each batch)."""
    return stream.join(seen.select(key), key, "left_anti")


def first_per_key_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "url",
                       order: Sequence[str] = ("event_time", "event_id")) -> None:
    """K6/K7: each micro-batch writes its earliest record per key into a
    ``batch_id`` partition (overwritten on replay, so reruns are idempotent);
    ``first_per_key`` over all partitions is the strict keep-first table."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        firsts = keep_first(batch, key, list(order)).withColumn("batch_id", F.lit(batch_id))
        (firsts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("batch_id").parquet(path))

    (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start().awaitTermination())


def first_per_key(spark: SparkSession, path: str, key: str = "url",
                  order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    return keep_first(spark.read.parquet(path).drop("batch_id"), key, list(order))


# --- K7: strict keep-first with keyed state -----------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key string, event_id long, at long, version int, change string, replaces long"


class EarliestRecord(StatefulProcessor):
    """Per key the earliest record so far, by (time, id).

    Rows out: ``first`` when a key appears, ``correction`` when an earlier record
    arrives later (``replaces`` names the record it supersedes), ``settled`` once the
    watermark has passed the record's time, after which no earlier one is admitted.
    The state of a key is one record; it stays, so a settled key's later records are
    known to be repeats.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("earliest", "at long, event_id long, version int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, event_id = min((r.at, r.event_id) for r in rows)
        old = self.kept.get() if self.kept.exists() else None
        if old is not None and (old[0], old[1]) <= (at, event_id):
            return
        version = 0 if old is None else old[2] + 1
        self.kept.update((at, event_id, version))
        if old is not None:
            self.handle.deleteTimer(old[0] // 1000)
        self.handle.registerTimer(at // 1000)
        yield Row(key=key[0], event_id=event_id, at=at, version=version, change="first" if old is None else "correction",
                  replaces=None if old is None else old[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            at, event_id, version = self.kept.get()
            yield Row(key=key[0], event_id=event_id, at=at, version=version, change="settled", replaces=None)

    def close(self) -> None:
        pass


def earliest_changes(stream: DataFrame, key: str = "url", delay: str = "60 days") -> DataFrame:
    """K7: changes (``CHANGE``, ``at`` in microseconds) to the earliest record per key.

    Null and empty keys are left out; records later than ``delay`` behind the newest
    are dropped by the watermark, so what has settled stays.
    """
    rows = (stream.where(F.col(key).isNotNull() & (F.col(key) != "")).withWatermark("event_time", delay)
                  .select(F.col(key).alias("key"), "event_time", F.unix_micros("event_time").alias("at"), "event_id"))
    return rows.groupBy("key").transformWithState(EarliestRecord(), CHANGE, "Append", "EventTime")


def run_earliest(stream: DataFrame, path: str, checkpoint: str, **options) -> None:
    """One ``availableNow`` run of ``earliest_changes`` into a Parquet table of changes."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        run_available_now(earliest_changes(stream, **options), path, checkpoint)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def earliest_now(changes: DataFrame) -> DataFrame:
    """The current record per key: its latest version (partial aggregation)."""
    latest = F.max(F.struct("version", "event_id", "at")).alias("l")
    return changes.groupBy("key").agg(latest).select("key", "l.event_id", "l.at", "l.version")
