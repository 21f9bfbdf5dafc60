"""Link collection and de-duplication.

"Keep first" is explicit: every record carries its batch and position, and
the first per key is the minimum of a struct ordered by those fields.  That
is a partial aggregation (map-side combine), so a URL seen in a third of all
rows is pre-reduced in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store


def extract_links(pages: DataFrame, html: str = "html", id_col: str = "page_id",
                  pattern: str = r'<a\s[^>]*href="([^"]*)"') -> DataFrame:
    """One row per link of each page: ``page_id, pos, url``."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 1))
                        ).withColumnRenamed("col", "url")


def paginate_until_empty(pages: DataFrame, session: str = "session", page: str = "page_num",
                         n_links: str = "n_links", limit: int = 5) -> DataFrame:
    """Pages 1..limit of each session up to (excluding) the first page
    without links.  The window is per session; a session has ≤ limit pages
    after the filter, which is applied first."""
    w = (Window.partitionBy(session).orderBy(page)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (pages.where(F.col(page) <= limit)
                 .withColumn("_min_links", F.min(n_links).over(w))
                 .where(F.col("_min_links") > 0).drop("_min_links"))


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
               drop_empty: bool = True) -> DataFrame:
    """The earliest record per key by ``order`` (a total order).

    ``min(struct(order..., rest...))`` is an ordinary aggregate with partial
    aggregation; null and empty keys are removed first (B9).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if drop_empty:
        for k in keys:
            df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest]))
    return (df.groupBy(*keys).agg(first.alias("_first"))
              .select(*keys, *[F.col("_first")[c].alias(c) for c in [*order, *rest]]))


def unseen(new: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key is not in ``seen`` (hash anti join; AQE
    broadcasts ``seen`` only when its measured size allows)."""
    return new.join(seen.select(key), key, "left_anti")


def known(new: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key is already in ``seen``."""
    return new.join(seen.select(key), key, "left_semi")


def new_unique(batch: DataFrame, seen: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First occurrence per key within the batch, minus keys seen before."""
    return unseen(keep_first(batch, key, order), seen, key)


def merge_append(existing: DataFrame, batch: DataFrame, key: str,
                 order: Sequence[str]) -> DataFrame:
    """What an incremental run appends: unseen keys of the batch, first
    occurrence only."""
    return new_unique(batch, existing.select(key).distinct(), key, order)


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E4."""
    return df.dropDuplicates(list(cols))


def split_outcomes(df: DataFrame, outcome: Column) -> tuple[DataFrame, DataFrame]:
    """Evaluate ``outcome`` (``struct<content, error>``) once, store it, and
    return (successes, errors)."""
    res = store(df.withColumn("_outcome", outcome), "outcomes")
    ok = (res.where(F.col("_outcome.error").isNull())
             .withColumn("content", F.col("_outcome.content")).drop("_outcome"))
    bad = (res.where(F.col("_outcome.error").isNotNull())
              .withColumn("error", F.col("_outcome.error")).drop("_outcome"))
    return ok, bad
