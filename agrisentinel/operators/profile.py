"""Profiling: describe, histograms, value counts, group sizes, class balance,
coverage.  Null keys are dropped first, as the reference's grouping does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import exact_quantiles, unpivot_numeric, value_counts_long

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True,
             accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column (long).

    One pass over the input: the long (column, value) table is reduced to
    distinct values with counts (partial aggregation; most measures repeat
    values) and checkpointed.  Every statistic comes from that table: the mean
    as an exact DECIMAL sum (order-independent, so any partitioning and any
    engine agree), the standard deviation in a second pass around the mean,
    quartiles from running counts.  ``exact=False`` sketches the quartiles
    with ``percentile_approx`` instead (no value table).
    """
    long = unpivot_numeric(df, cols)
    if not exact:
        long = long.where(F.col("value").isNotNull())
        exact_sum = F.sum(F.col("value").cast("decimal(38,9)")).cast("double")
        moments = long.groupBy("col_name").agg(
            F.count("value").alias("count"), (exact_sum / F.count("value")).alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile_approx("value", list(QUARTILES), accuracy).alias("_q"))
        return moments.select("col_name", "count", "mean", "std", "min",
                              *[F.col("_q")[i].alias(n) for i, n in
                                enumerate(("q25", "q50", "q75"))], "max")
    counted = cut_lineage(value_counts_long(long, "col_name", "value"))
    v, c = F.col("value"), F.col("_cnt")
    base = counted.groupBy("col_name").agg(
        F.sum(c).alias("count"),
        # decimal(25,9) × decimal(12,0) fits decimal(38,9): the product is exact
        (F.sum(v.cast("decimal(25,9)") * c.cast("decimal(12,0)")).cast("double")
         / F.sum(c)).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    spread = (counted.join(F.broadcast(base.select("col_name", "mean")), "col_name")
                     .groupBy("col_name")
                     .agg(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("_ss")))
    q = exact_quantiles(None, "col_name", "value", QUARTILES, counted=counted)
    qs = q.groupBy("col_name").pivot("p", list(QUARTILES)).agg(F.first("q"))
    qs = qs.select("col_name", *[F.col(f"`{p}`").alias(n)
                                 for p, n in zip(QUARTILES, ("q25", "q50", "q75"))])
    return (base.join(spread, "col_name").join(qs, "col_name", "left")
                .select("col_name", "count", "mean",
                        F.sqrt(F.col("_ss") / F.nullif(F.col("count") - 1, F.lit(0))).alias("std"),
                        "min", "q25", "q50", "q75", "max"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """D3: equal-width bins per column, last bin closed on the right.

    min/max per column come from one aggregation (a row per column) and are
    broadcast back; every value is bucketed by floor arithmetic.
    """
    long = unpivot_numeric(df, cols).where(F.col("value").isNotNull())
    bounds = long.groupBy("col_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
    return (long.join(F.broadcast(bounds), "col_name")
                .withColumn("bin", b.cast("int"))
                .groupBy("col_name", "bin")
                .agg(F.count(F.lit(1)).alias("count"),
                     F.first("lo").alias("lo"), F.first("hi").alias("hi"))
                .select("col_name", "bin",
                        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
                        .alias("bin_start"), "count"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of non-null values, count desc then value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("count")))


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of each group; rows with a null key are dropped."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def series_by(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Per-key max and mean of a measure (the bar heights)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.max(measure).alias(f"max_{measure}"), F.avg(measure).alias(f"avg_{measure}")))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """positives/negatives and its inverse, one row."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"),
                  (pos / F.nullif(neg, F.lit(0))).alias("pos_per_neg"),
                  (neg / F.nullif(pos, F.lit(0))).alias("neg_per_pos"))


def class_frequencies(df: DataFrame, label: str) -> DataFrame:
    """D9."""
    return value_counts(df, label)


def top_origins(df: DataFrame, col: str, n: int = 3, unknown: str = "unknown") -> DataFrame:
    """Records per origin with missing origins counted as ``unknown``;
    the n largest (a top-n report: TakeOrderedAndProject, no global sort)."""
    counts = (df.groupBy(F.coalesce(F.col(col), F.lit(unknown)).alias(col))
                .agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy(F.desc("count"), F.asc(col)).limit(n)


def year_coverage(df: DataFrame, year: str = "year") -> DataFrame:
    """Every year between the first and the last with its record count;
    missing years get 0.  The year sequence is generated from two scalars."""
    lo = df.select(F.min(year)).scalar()
    hi = df.select(F.max(year)).scalar()
    spark = df.sparkSession
    years = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias(year))
    counts = group_size(df, [year])
    return (years.join(counts, year, "left")
                 .select(year, F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def outlier_share(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Share of documents without a topic (−1)."""
    return df.agg(F.avg((F.col(topic) == -1).cast("double")).alias("outlier_share"))
