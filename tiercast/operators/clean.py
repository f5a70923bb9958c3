"""Row-level cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tiercast.functions.columns import safe_date


def safe_dates(df: DataFrame, column: str) -> DataFrame:
    """Read ``column`` as a date and drop the rows where that fails."""
    return df.withColumn(column, safe_date(F.col(column))).dropna(subset=[column])


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, nulls first, then by the other columns.

    An aggregate, not a window: copies of a key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def count_rows(df: DataFrame, **distinct: str | Column) -> DataFrame:
    """Row count and named distinct counts, one row."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
    )
