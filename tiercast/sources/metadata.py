"""The run-metadata document: one row that fixes the calendar for later steps."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import iso_day

SCHEMA = """
    event_max_date string, persona_max_date string, persona_snapshot_is_stale boolean,
    data_max_date string, window_days int, outcome_buffer_days int,
    live_snapshot_t string, live_snapshot_is_training_eligible boolean,
    snapshots array<struct<T: string, feature_window_start: string,
                           feature_window_end: string, check_day: string>>
"""


def run_metadata(grid: DataFrame, horizon: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Bounds, stale flag, window settings, live T and the training snapshots."""
    entry = F.struct(
        iso_day(F.col("snapshot_t")).alias("T"),
        iso_day(F.col("window_start")).alias("feature_window_start"),
        iso_day(F.col("snapshot_t")).alias("feature_window_end"),
        iso_day(F.col("check_day")).alias("check_day"),
    )
    # The grid holds one row per calendar month, so this list stays short.
    summary = grid.agg(
        F.struct(
            F.sort_array(F.collect_list(F.when(F.col("is_training"), entry))).alias("snapshots"),
            F.max(F.when(F.col("is_live"), iso_day(F.col("snapshot_t")))).alias("live_t"),
            F.bool_or(F.col("is_live") & F.col("is_training")).alias("live_is_training"),
        ).alias("s")
    )
    return horizon.withColumn("s", summary.scalar()).select(
        iso_day(F.col("event_max")).alias("event_max_date"),
        iso_day(F.col("persona_max")).alias("persona_max_date"),
        F.col("is_stale").alias("persona_snapshot_is_stale"),
        iso_day(F.col("data_max")).alias("data_max_date"),
        F.lit(cfg.window_days).alias("window_days"),
        F.lit(cfg.buffer_days).alias("outcome_buffer_days"),
        F.col("s.live_t").alias("live_snapshot_t"),
        F.col("s.live_is_training").alias("live_snapshot_is_training_eligible"),
        F.col("s.snapshots").alias("snapshots"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The document at ``path``; a missing one is an error, a stale one a warning."""
    try:
        metadata = spark.read.schema(SCHEMA).json(path)
        row = metadata.drop("snapshots").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{path}: no run metadata; build the calendar first") from e
    if row is None:
        raise FileNotFoundError(f"{path}: the run metadata is empty; build the calendar first")
    if row.persona_snapshot_is_stale:
        warnings.warn(
            f"tier history ends on {row.persona_max_date}, before the last event day "
            f"{row.event_max_date}: population and labels follow the older one",
            stacklevel=2,
        )
    return metadata


def grid_from_metadata(metadata: DataFrame) -> DataFrame:
    """The snapshot grid as the document records it: training snapshots plus the live one."""
    days = metadata.select(
        F.explode("snapshots.T").alias("t"),
        "window_days", "outcome_buffer_days", "live_snapshot_t",
        F.lit(True).alias("is_training"),
    ).unionByName(
        metadata.filter(~F.col("live_snapshot_is_training_eligible")).select(
            F.col("live_snapshot_t").alias("t"),
            "window_days", "outcome_buffer_days", "live_snapshot_t",
            F.lit(False).alias("is_training"),
        )
    )
    t = F.col("t").cast("date")
    return days.select(
        t.alias("snapshot_t"),
        F.date_sub(t, F.col("window_days") - 1).alias("window_start"),
        F.date_add(t, F.col("outcome_buffer_days") + 1).alias("check_day"),
        "is_training",
        (F.col("t") == F.col("live_snapshot_t")).alias("is_live"),
    )
