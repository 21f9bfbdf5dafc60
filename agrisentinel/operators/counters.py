"""Counters of a run and distinct counts that add up.

* ``observed_write`` counts while a table is written (``observe``): the figures cost
  no job of their own and describe exactly the rows that the write saw.
* ``daily_sketches`` stores one HyperLogLog sketch per day; ``merged_counts`` adds
  days up from the sketches alone, without the rows.  The relative standard error of
  a sketch with 2**``LG_K`` registers is about 1.04 / sqrt(2**LG_K), union included;
  ``error_bound`` is three of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    return 3 * 1.04 / 2 ** (lg_k / 2)


def observed_write(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``df`` as Parquet to ``path``; the metrics of the rows written."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.parquet(path)
    return seen.get


def daily_sketches(df: DataFrame, day: Column, value: str, lg_k: int = LG_K) -> DataFrame:
    """``day, n, sketch``: rows and a sketch of the distinct values of each day (nulls count as rows only)."""
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_counts(sketches: DataFrame, *by: Column) -> DataFrame:
    """Rows and estimated distinct values per ``by``, from stored sketches."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), merged.alias("estimate"))
