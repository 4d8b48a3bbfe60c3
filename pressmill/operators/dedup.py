"""Duplicate report and de-duplication (A1-A3, F11 in-batch).

Keep-first/keep-last are ``min_by``/``max_by`` aggregations, not windows:
the aggregate is combined map-side, so a URL that holds a third of all rows
is reduced to one row per task before the shuffle instead of landing whole
in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_report(df: DataFrame, key: str = "article_url") -> DataFrame:
    """A1: keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _pick(df: DataFrame, key: str, order: str, fn) -> DataFrame:
    cols = df.columns
    return (df.groupBy(key)
            .agg(fn(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_row"))
            .select(*[F.col("_row")[c].alias(c) for c in cols]))


def keep_first(df: DataFrame, key: str = "article_url", order: str = "id") -> DataFrame:
    """A2: one row per key, the one with the smallest ``order``."""
    return _pick(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: str = "article_url", order: str = "id") -> DataFrame:
    """A3: one row per key, the one with the largest ``order``."""
    return _pick(df, key, order, F.max_by)


def removed_duplicates(df: DataFrame, key: str = "article_url", order: str = "id") -> DataFrame:
    """The rows keep-first deletes (everything but the first of each key)."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    return (df.join(firsts, key)
            .filter(F.col(order) != F.col("_first")).drop("_first"))
