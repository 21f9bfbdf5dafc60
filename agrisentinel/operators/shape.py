"""Column families, ordering, positional selection, splits and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values (must equal the reference's): the 27 leading columns of the
# monitoring table, in the reference's order, and the label column.
BASE_COLUMNS = [
    "hazard", "year", "month", "origin_code3", "notified_code3",
    "volume_avg", "price_avg", "volume_sum", "price_sum", "continent",
    "corruption_index", "human_development_index", "control_corruption",
    "government_effectiveness", "political_stability", "regulatory_quality",
    "rule_of_law", "voice_and_accountability", "governance_index",
    "press_freedom_index", "democracy_index", "polity_democracy_index",
    "gdp_current", "gdp_growth", "legal_system", "food_security_index",
    "innovation_index",
]
LABEL = "exceeding_loq"
# Weather variables and statistics; months run 1..12.
WEATHER_VARS = ["temperature_max", "temperature_mean", "temperature_min",
                "precipitation_mean", "relative_humidity_mean"]
WEATHER_STATS = ["mean", "sum"]
WEATHER_MONTHS = range(1, 13)

# Generated, variable-major, then statistic, then month (120 names).
WEATHER_COLUMNS = [f"{v}_{s}_{k}" for v in WEATHER_VARS for s in WEATHER_STATS
                   for k in WEATHER_MONTHS]
INDEX_COLUMNS = BASE_COLUMNS[10:]
DESIRED_ORDER = BASE_COLUMNS + WEATHER_COLUMNS + [LABEL]


def weather_value_expr_sql(name: str) -> str:
    """Deterministic stand-in value of a generated column (``mon_wide``):
    arithmetic of origin country, month/year and the column's position; about
    every seventh value is null.  Portable between Spark SQL and DuckDB."""
    if name in INDEX_COLUMNS:
        i = INDEX_COLUMNS.index(name) + 1
        return (f"CAST((origin_key * {7 * i + 3} + year * {i}) % 101 AS DOUBLE) / 10")
    var, rest = None, None
    for v in WEATHER_VARS:
        if name.startswith(v + "_"):
            var, rest = v, name[len(v) + 1:]
    stat, k = rest.rsplit("_", 1)
    vi, si, k = WEATHER_VARS.index(var), WEATHER_STATS.index(stat), int(k)
    return (f"CASE WHEN (origin_key + month + {k + vi}) % 7 = 0 THEN NULL "
            f"ELSE CAST((origin_key * 31 + month * 7 + {3 * k + 11 * vi + 5 * si}) % 97 "
            f"AS DOUBLE) / 4 END")


def reorder(df: DataFrame, order: list[str] = DESIRED_ORDER, keep: list[str] = ()) -> DataFrame:
    """B2: select ``order`` (label last), keeping extra key columns in front."""
    return df.select(*keep, *order)


def family(df: DataFrame, var: str, stat: str) -> DataFrame:
    """One ``{var}_{stat}_{k}`` family via a column regex."""
    return df.select(df.colRegex(f"`^{var}_{stat}_[0-9]+$`"))


def positional(df: DataFrame, start: int, stop: int | None = -1) -> list[str]:
    """Names of ``iloc[:, start:stop]`` resolved once to names."""
    return df.columns[start:stop]


def string_columns(df: DataFrame) -> list[str]:
    """Columns of string type (the categorical candidates)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def hash_bucket(key: Column | str, buckets: int = 100) -> Column:
    """First 8 hex digits of md5(key) as a number, modulo ``buckets``.

    Deterministic and identical in DuckDB
    (``('0x' || substr(md5(k), 1, 8))::BIGINT % buckets``)."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10)
            .cast("bigint") % buckets)


def split_flag(df: DataFrame, key: str = "row_key", test_percent: int = 20,
               name: str = "is_test") -> DataFrame:
    """M1: deterministic train/test split by a hash of the row key."""
    return df.withColumn(name, hash_bucket(key) < test_percent)


def fixed_weights(label: str = LABEL, weights: dict[int, float] | None = None) -> Column:
    """M3: per-row weight from a fixed class → weight map (default 0:1, 1:3)."""
    weights = weights or {0: 1.0, 1: 3.0}
    expr = None
    for cls, w in weights.items():
        expr = (F.when(F.col(label) == cls, F.lit(float(w))) if expr is None
                else expr.when(F.col(label) == cls, F.lit(float(w))))
    return expr.otherwise(F.lit(1.0))


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M4: ``n / (k · n_c)`` per class; ``n`` and ``k`` are scalar subqueries
    over the (partially aggregated) class table, so no join is needed."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = counts.select(F.sum("n_c")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def with_balanced_weight(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    w = balanced_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(w), label, "left")
