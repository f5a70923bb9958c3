"""Snapshot calendar: data horizon, month-end grid, training and live snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import safe_date

GRID_SCHEMA = (
    "snapshot_t date, window_start date, check_day date, is_training boolean, is_live boolean"
)


def last_event(usage: DataFrame, cfg: PanelConfig, known: dt.date | None = None) -> DataFrame:
    """The last day with an event of the scope, one row.

    With ``known``, a day that is known to have one, only facts from that day on are
    read: the literal reaches the scan, so older files and row groups are skipped.
    """
    events = usage.filter(F.col("product").isin(*cfg.products)) if cfg.products else usage
    if known is not None:
        events = events.filter(F.col("time_period") >= F.lit(known))
    day = F.max(F.to_date("time_period"))
    return events.agg((day if known is None else F.greatest(day, F.lit(known))).alias("event_max"))


def data_horizon(usage: DataFrame, personas: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row: last event day, first and last tier day, the earlier end, staleness."""
    day = safe_date(F.col("score_date"))
    return horizon_of(last_event(usage, cfg), personas.select(day.alias("joined"), day.alias("last_day")))


def horizon_of(event_max: DataFrame, spans: DataFrame) -> DataFrame:
    """``data_horizon`` from the last event day and from spans (joined, last_day) that cover the tier history."""
    return (
        spans.agg(F.min("joined").alias("persona_min"), F.max("last_day").alias("persona_max"))
        .withColumn("event_max", event_max.scalar())
        .select(
            "event_max", "persona_min", "persona_max",
            F.least("event_max", "persona_max").alias("data_max"),
            (F.col("persona_max") < F.col("event_max")).alias("is_stale"),
        )
    )


def snapshot_grid(horizon: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Month ends between the first tier day and the horizon, both included.

    At most one row per calendar month of the horizon, whatever the data volume.
    """
    first_month = F.trunc("persona_min", "MM")
    months = horizon.filter(F.col("persona_min") <= F.col("data_max")).select(
        "data_max",
        F.explode(F.sequence(first_month, F.col("data_max"), F.expr("interval 1 month"))).alias("m"),
    )
    t = F.col("snapshot_t")
    return (
        months.select("data_max", F.last_day("m").alias("snapshot_t"))
        .filter(t <= F.col("data_max"))
        .select(
            "snapshot_t",
            F.date_sub(t, cfg.window_days - 1).alias("window_start"),
            F.date_add(t, cfg.buffer_days + 1).alias("check_day"),
            (F.date_add(t, cfg.buffer_days + 1) <= F.col("data_max")).alias("is_training"),
            # The last complete month: the next month end lies past the horizon.
            (F.last_day(F.add_months(t, 1)) > F.col("data_max")).alias("is_live"),
        )
    )


def pin(grid: DataFrame) -> DataFrame:
    """The grid as fixed local rows, so that later plans do not rescan the inputs for it."""
    rows = grid.collect()  # one row per calendar month
    if not rows:
        raise ValueError("no complete month between the first tier day and the data horizon")
    return grid.sparkSession.createDataFrame(rows, GRID_SCHEMA)


def training_snapshots(grid: DataFrame) -> DataFrame:
    return grid.filter("is_training")


def live_snapshot(grid: DataFrame) -> DataFrame:
    return grid.filter("is_live")


def recent(grid: DataFrame, months: int | None) -> DataFrame:
    """The newest ``months`` training snapshots; all of them for ``None``."""
    training = training_snapshots(grid)
    return training if months is None else training.orderBy(F.desc("snapshot_t")).limit(months)


def segment_days(grid: DataFrame) -> DataFrame:
    """Snapshots that need an account segment: the training ones and the live one."""
    return grid.filter(F.col("is_training") | F.col("is_live")).select("snapshot_t")


def on_days(df: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """The rows of ``df`` dated on one of ``days``, a one-column slice of the grid.

    The few days become a literal list: it prunes the folders of a history laid
    out by day, which a join would only do at run time and only if Spark deems
    the other side selective.
    """
    wanted = sorted({row[0] for row in days.collect()})  # a handful per calendar month
    return df.filter(F.col(column).isin(wanted) if wanted else F.lit(False))
