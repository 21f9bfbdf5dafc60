"""File scans and sinks.

Readers always take an explicit schema (no inference pass over the data);
writers never funnel rows through the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import store

CORRUPT = "_corrupt_record"


class MissingColumns(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             header: bool = True, with_source: bool = False) -> DataFrame:
    """A1/A3: CSV with a header and an explicit schema; a directory or glob
    reads every file, ``with_source`` adds the file name as provenance."""
    df = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)
    if with_source:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str,
              multiline: bool = False) -> DataFrame:
    """A2: JSON Lines (splittable) or, with ``multiline``, files holding one
    JSON array each (every element a row; such files do not split, so ingest
    them once and keep JSON Lines / Parquet)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """A4: reject an input that lacks a required column (case-sensitive),
    before any action runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def read_json_permissive(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """A5: parse JSON Lines keeping malformed lines; returns (good, corrupt).

    Malformed lines land in ``_corrupt_record``; the caller routes them to an
    error sink instead of failing the job.
    """
    full = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    df = (spark.read.schema(full).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    df = store(df, "permissive")  # parsed once for both outputs
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


# Fixed value (must equal the reference's): the date placeholder of RSS items.
NO_DATE = "No date available"
RSS_SCHEMA = "channel STRUCT<item: ARRAY<STRUCT<link: STRING, pubDate: STRING, title: STRING>>>"


def parse_rss(df: DataFrame, xml: str = "xml", keep: Sequence[str] = ()) -> DataFrame:
    """One row per ``<item>`` of an RSS document column: ``url, date``;
    an item without ``pubDate`` gets the placeholder date; items without a
    link are dropped."""
    parsed = df.select(*keep, F.from_xml(F.col(xml), RSS_SCHEMA).alias("_rss"))
    items = parsed.select(*keep, F.inline_outer("_rss.channel.item"))
    return (items.where(F.col("link").isNotNull())
                 .select(*keep, F.col("link").alias("url"),
                         F.coalesce(F.col("pubDate"), F.lit(NO_DATE)).alias("date")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> None:
    """A10: JSON Lines, written in parallel."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: Sequence[str] = (), array_sep: str = "; ") -> None:
    """CSV with header; array columns are joined into text first."""
    from pyspark.sql.types import ArrayType
    cols = [F.array_join(F.col(f.name).cast("array<string>"), array_sep).alias(f.name)
            if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields]
    w = df.select(*cols).write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_dated(df: DataFrame, path: str, run_date: str, source: str | None = None,
                fmt: str = "json") -> None:
    """Output stamped per run date and input file, as partition columns
    instead of file names (``run_date=YYYYMMDD/source_file=…``)."""
    out = df.withColumn("run_date", F.lit(run_date))
    parts = ["run_date"]
    if source is not None:
        out = out.withColumn("source_file", F.lit(source)) if source else out
        parts.append("source_file")
    elif "source_file" in df.columns:
        parts.append("source_file")
    getattr(out.write.mode("append").partitionBy(*parts), fmt)(path)
