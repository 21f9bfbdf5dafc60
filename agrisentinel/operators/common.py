"""Distributed building blocks shared by the operators.

None of these sends a whole group (or the whole table) to one task:

* ``top_k_per_group`` ranks inside salted sub-groups first, so a hot group
  is cut to ``k`` rows per salt bucket before the final per-group rank.
* ``running_totals`` computes ordered prefix sums over range partitions
  (sampled, balanced) and adds per-partition offsets from a small table.
* ``exact_quantiles`` finds order statistics from distinct values and their
  running counts; nothing holds all values of a column in one buffer.
* ``dense_order_ids`` numbers rows of an ordering (0, 1, 2, …) the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                    k: int, rank_col: str = "rank", salt_buckets: int | None = None,
                    salt_key: Sequence[str] | None = None) -> DataFrame:
    """Rows ranked 1..k per ``group`` by ``order`` (which must be a total order).

    Stage 1 ranks within (group, salt) and keeps ≤ k rows per salt bucket;
    stage 2 ranks the ≤ k·buckets survivors per group.  The result equals a
    plain ``row_number() <= k``.
    """
    buckets = _partitions(df, salt_buckets)
    key = _cols(salt_key) if salt_key else [F.col(c) for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*_cols(order))
    stage1 = (salted.withColumn("_r1", F.row_number().over(w1))
                    .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*_cols(order))
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   values: Sequence[str], suffix: str = "_cum",
                   ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``group`` ordered by ``order``.

    ``order`` must be unique within a group.  Rows are range-partitioned on
    (group, order) from a sample, so every task gets a balanced slice even if
    one group holds most rows; each slice sums locally and the offset of each
    slice comes from a table of per-slice totals (≤ slices + groups rows).
    """
    n = _partitions(df, ranges)
    r = (df.repartitionByRange(n, *group, *order)
           .withColumn("_pid", F.spark_partition_id()))
    w_local = (Window.partitionBy("_pid", *group).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumns({f"_loc_{v}": F.sum(v).over(w_local) for v in values})
    totals = r.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    w_prev = (Window.partitionBy(*group).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        "_pid", *group,
        *[F.coalesce(F.sum(f"_tot_{v}").over(w_prev), F.lit(0)).alias(f"_off_{v}")
          for v in values])
    joined = local.join(offsets, ["_pid", *group])
    return joined.select(
        *df.columns,
        *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{v}{suffix}") for v in values])


def dense_order_ids(df: DataFrame, order: Sequence[str], name: str = "idx",
                    group: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (unique), per ``group``."""
    one = df.withColumn("_one", F.lit(1))
    out = running_totals(one, group, order, ["_one"], ranges=ranges)
    return out.withColumn(name, F.col("_one_cum") - 1).drop("_one", "_one_cum")


def value_counts_long(long: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, _cnt``: distinct non-null values per key with counts."""
    return (long.where(F.col(value).isNotNull())
                .groupBy(key, value).agg(F.count(F.lit(1)).alias("_cnt")))


def exact_quantiles(long: DataFrame, key: str, value: str,
                    probs: Sequence[float], ranges: int | None = None,
                    counted: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``describe`` / DuckDB
    ``quantile_cont``) of ``value`` per ``key``; nulls ignored.

    Output: ``key, p, q``.  Works on distinct values with counts (pass
    ``counted`` = ``value_counts_long(...)`` to reuse them), their running
    counts (range-partitioned), and a small (key × p) target table.
    """
    distinct = counted if counted is not None else value_counts_long(long, key, value)
    cum = running_totals(distinct, [key], [value], ["_cnt"], ranges=ranges)
    sizes = distinct.groupBy(key).agg(F.sum("_cnt").alias("_n"))
    # keys × |probs| rows: bounded by the number of profiled columns
    targets = F.broadcast(
        sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
             .withColumn("_lo", F.floor("_h"))
             .withColumn("_hi", F.ceil("_h")))
    # the distinct value whose index range [cum - cnt, cum - 1] holds position i
    lo = targets.alias("t").join(
        cum.alias("c"),
        (F.col("t." + key) == F.col("c." + key))
        & (F.col("c._cnt_cum") - F.col("c._cnt") <= F.col("t._lo"))
        & (F.col("t._lo") < F.col("c._cnt_cum")))
    lo = lo.select(F.col("t." + key).alias(key), "t.p", "t._h", "t._lo", "t._hi",
                   F.col("c." + value).alias("_vlo"))
    hi = F.broadcast(lo).alias("t").join(
        cum.alias("c"),
        (F.col("t." + key) == F.col("c." + key))
        & (F.col("c._cnt_cum") - F.col("c._cnt") <= F.col("t._hi"))
        & (F.col("t._hi") < F.col("c._cnt_cum")))
    return hi.select(
        F.col("t." + key).alias(key), F.col("t.p").alias("p"),
        (F.col("t._vlo") + (F.col("t._h") - F.col("t._lo"))
         * (F.col("c." + value) - F.col("t._vlo"))).alias("q"))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], key: str = "col_name",
                    value: str = "value") -> DataFrame:
    """Wide → long (one row per cell) with doubles, for per-column statistics."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), key, value)
