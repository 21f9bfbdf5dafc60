"""Identical rounding in Spark and DuckDB.

Both engines' ``round`` differ on halves (decimal vs binary), so results are
rounded as ``floor(x * 10^d + 0.5) / 10^d`` in double arithmetic on both
sides, which gives bit-identical doubles for identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fround(c: Column | str, d: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** d)
    return (F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def sround(expr: str, d: int = 6) -> str:
    scale = 10 ** d
    return (f"(CAST(floor(({expr}) * CAST({scale} AS DOUBLE) + 0.5) AS DOUBLE)"
            f" / CAST({scale} AS DOUBLE))")
