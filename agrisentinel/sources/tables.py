"""Readers for the parquet tables every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Fact and text tables feed CPU-heavy map stages (broadcast-join pipelines,
# regex/array work).  When a scan yields fewer splits than the cluster has
# cores (a small file with a single row group), spread it round-robin first;
# a large table already has many splits and is left alone.
TEXT_TABLES = {"documents", "pages", "conversations", "lineitem", "orders", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan."""
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        try:
            cores = spark.sparkContext.defaultParallelism
            splits = df.rdd.getNumPartitions()
        except Exception:  # noqa: BLE001 - e.g. a Connect session has no RDD view
            return df
        if splits < cores:
            df = df.repartition(cores)
    return df


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Read NaN as null so null-skipping aggregates and sorts behave like the
    reference's (NaN is 'missing' there, a value in Spark)."""
    floating = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (DoubleType, FloatType))]
    targets = [c for c in (cols or floating) if c in floating]
    if not targets:
        return df
    return df.withColumns({
        c: F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)) for c in targets
    })
