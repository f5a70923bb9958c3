"""Usage facts per snapshot window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tiercast.config import PanelConfig

CATALOG_KEYS = ["product", "feature", "sub_feature"]


def usage_scope(usage: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Products in scope and features outside the denied family.

    The prefix test is null for a missing sub-feature, so such rows leave.
    """
    if cfg.products:
        usage = usage.filter(F.col("product").isin(*cfg.products))
    if cfg.denied_prefix:
        usage = usage.filter(~F.col("sub_feature").startswith(cfg.denied_prefix))
    return usage


def denied_table(spark: SparkSession, cfg: PanelConfig) -> DataFrame:
    """The configured denylist; as short as the configuration, hence broadcast."""
    rows = [(name,) for name in cfg.denied_features]
    return F.broadcast(spark.createDataFrame(rows, "sub_feature string"))


def drop_denied(usage: DataFrame, denied: DataFrame) -> DataFrame:
    """Anti join: rows with a denied sub-feature leave, rows without a name stay."""
    return usage.join(denied, "sub_feature", "left_anti")


def _bin(day, width: int):
    return F.floor(F.unix_date(day) / F.lit(width))


def _within(usage: DataFrame, grid: DataFrame) -> Column:
    """True from the first window's start to the last snapshot, in a form that scans push down."""
    lo, hi = grid.agg(F.min("window_start"), F.max("snapshot_t")).first()
    if lo is None:
        return F.lit(False)
    kind = usage.schema["time_period"].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        after = F.lit(hi + dt.timedelta(days=1))
        return (F.col("time_period") >= F.lit(lo).cast(kind)) & (F.col("time_period") < after.cast(kind))
    return (F.col("time_period") if isinstance(kind, DateType) else F.to_date("time_period")).between(F.lit(lo), F.lit(hi))


def window_range_join(usage: DataFrame, grid: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Each usage row once per snapshot window [window_start, T] that holds its day.

    Days are numbered in bins as wide as a window, so a window touches at most
    two bins. The grid is spread over its bins and hash-joined on the bin; the
    range test is left as the residual condition. The fact rows are neither
    multiplied nor shuffled. The grid's first and last day stand as literals on
    the raw column, so that the scan skips files and row groups outside them.
    """
    day = F.to_date("time_period")
    binned = grid.select(
        "snapshot_t",
        "window_start",
        F.explode(
            F.sequence(
                _bin(F.col("window_start"), cfg.window_days), _bin(F.col("snapshot_t"), cfg.window_days)
            )
        ).alias("_bin"),
    )
    return (
        usage.filter(_within(usage, grid))
        .withColumn("_bin", _bin(day, cfg.window_days))
        # At most two rows per snapshot, one snapshot per calendar month.
        .join(F.broadcast(binned), "_bin")
        .filter(day.between(F.col("window_start"), F.col("snapshot_t")))
        .drop("_bin")
    )


def counted_catalog(catalog: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Catalog keys that count as usage, one row each, with their multiplicity.

    A repeated catalog key multiplies the sums of its events; carrying the
    number of copies gives that result without multiplying the fact rows.
    Grouping also by the flag, the same for all rows kept, keeps the shuffle of
    the grouping apart from that of the join, so that Spark can split a hot
    feature there should the catalog be too large to broadcast.
    """
    counted = catalog.filter(F.col("is_counted").eqNullSafe(True))
    copies = F.lit(1).cast("bigint") if cfg.dedupe_catalog else F.count("*")
    return (
        counted.groupBy(
            "product", "feature", F.coalesce("sub_feature", F.lit("")).alias("_sub"), "is_counted"
        )
        .agg(copies.alias("copies"))
        .drop("is_counted")
    )


def windowed_usage(
    usage: DataFrame,
    grid: DataFrame,
    catalog: DataFrame,
    cfg: PanelConfig,
    denied: DataFrame | None = None,
) -> DataFrame:
    """Events and active days per (user, snapshot, sub-feature).

    Scope filters run at the scan. The catalog join carries no hint: Spark
    broadcasts the catalog if its measured size allows and else splits skewed
    keys, as the aggregate below regroups the rows by user anyway.
    """
    scoped = usage_scope(usage, cfg)
    if denied is not None:
        scoped = drop_denied(scoped, denied)
    elif cfg.denied_features:
        # As long as the configured list; a row without a name is kept.
        scoped = scoped.filter(
            F.coalesce(~F.col("sub_feature").isin(*cfg.denied_features), F.lit(True))
        )
    counted = (
        window_range_join(scoped, grid, cfg)
        .withColumn("_sub", F.coalesce("sub_feature", F.lit("")))
        .join(counted_catalog(catalog, cfg), ["product", "feature", "_sub"])
    )
    return counted.groupBy("user_id", "snapshot_t", "sub_feature").agg(
        F.sum(F.col("event_count") * F.col("copies")).alias("early_events"),
        _active_days(usage, cfg).alias("early_active_days"),
    )


def _active_days(usage: DataFrame, cfg: PanelConfig):
    """Distinct ``time_period`` values within a window.

    Daily facts with a window of at most 63 days use one bit per day: that
    combines before the shuffle and needs one shuffle instead of two.
    """
    daily = isinstance(usage.schema["time_period"].dataType, DateType)
    if not daily or cfg.window_days > 63:
        return F.count_distinct("time_period")
    age = F.datediff("snapshot_t", "time_period")
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), age))).cast("bigint")
