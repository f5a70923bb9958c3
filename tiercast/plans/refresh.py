"""Months that arrived after a run: their usage, segments and tiers added to the run's folder, and scored.

The saved metadata say how far the run's tables went. Only month ends beyond
that are aggregated, over their own windows; folders of older months are not
written again. The metadata are written last, so a refresh that fails is
simply repeated: what it had added is replaced by the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tiercast.config import PanelConfig
from tiercast.operators import boosting, calendar, population, usage as usage_ops
from tiercast.plans.live import Forecast, forecast
from tiercast.plans.run import (
    PanelTables, read_facts, read_spans, read_tier_days, write_facts, write_live, write_personas, write_tier_days,
)
from tiercast.sources import metadata, sinks
from tiercast.sources.storage import side_by_side, write_through


def _saved(spark: SparkSession, run: str, cfg: PanelConfig) -> tuple[DataFrame, dt.date, dt.date, dt.date]:
    """The saved grid, the last day of the saved tables, the last tier day and the last event day."""
    document = metadata.read_metadata(spark, f"{run}/metadata")
    row = document.drop("snapshots").first()
    if (row.window_days, row.outcome_buffer_days) != (cfg.window_days, cfg.buffer_days):
        raise ValueError(
            f"{run} was made with window_days={row.window_days}, buffer_days={row.outcome_buffer_days}; "
            f"the configuration says {cfg.window_days}, {cfg.buffer_days}")
    days = [dt.date.fromisoformat(d) for d in (row.data_max_date, row.persona_max_date, row.event_max_date)]
    return metadata.grid_from_metadata(document), *days


def new_snapshots(grid: DataFrame, last_day: dt.date, again_from: dt.date | None = None) -> DataFrame:
    """Month ends of a fresh grid beyond ``last_day``, and those from ``again_from`` on."""
    known_to = last_day if again_from is None else min(last_day, again_from - dt.timedelta(days=1))
    return grid.filter(F.col("snapshot_t") > F.lit(known_to))


def new_segment_days(grid: DataFrame, saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Days that need segments and have none: those of new month ends, and older ones that have come into use."""
    known = calendar.segment_days(saved).join(fresh.select("snapshot_t"), "snapshot_t", "left_anti")
    return calendar.segment_days(grid).join(known, "snapshot_t", "left_anti")


def add_months(
    spark: SparkSession, run: str, tables: PanelTables, cfg: PanelConfig, again_from: dt.date | None = None,
) -> DataFrame:
    """Bring usage, segments, tiers and metadata below ``run`` up to ``tables``; returns the new grid.

    Facts up to the saved last day count as known and are not read again, but for
    the windows of month ends from ``again_from`` on, for facts that came late.
    Without a new month end nothing but tiers and metadata is written. Tiers are kept by month: the
    month of the last saved day and later ones are replaced, with the rows without a readable day,
    and so are the per-user facts and the grid days of those months. The new horizon comes from the
    merged facts and from events since the saved last one, so it never moves back.
    """
    saved, last_day, last_tier_day, event_day = _saved(spark, run, cfg)
    since = min(last_tier_day, again_from) if again_from else last_tier_day
    write_personas(tables.personas, run, since)
    write_facts(spark, run, cfg, since)
    events = calendar.last_event(tables.usage, cfg, known=event_day)
    horizon = write_through(calendar.horizon_of(events, read_spans(spark, run)), "horizon")
    grid = calendar.pin(calendar.snapshot_grid(horizon, cfg))
    fresh = new_snapshots(grid, last_day, again_from)

    def add_usage() -> None:
        if not fresh.isEmpty():
            sinks.add_usage(usage_ops.windowed_usage(tables.usage, fresh, tables.catalog, cfg), f"{run}/usage_long")

    def add_tiers() -> None:
        write_tier_days(spark, run, grid, since)
        if tables.account_state is not None:
            days = new_segment_days(grid, saved, fresh)
            if not days.isEmpty():
                segments = population.segment_at_snapshot(read_tier_days(spark, run), tables.account_state, days)
                sinks.write_segments(segments, f"{run}/segments", add=True)

    side_by_side(spark, add_usage, add_tiers)
    # Read back: a JSON document of one row, complete before it replaces the old one.
    metadata.write_metadata(metadata.run_metadata(grid, horizon, cfg), f"{run}/metadata")
    return grid


def score_new_month(
    spark: SparkSession, run: str, tables: PanelTables, cfg: PanelConfig, out: str, again_from: dt.date | None = None,
) -> Forecast:
    """The newest complete month of ``tables`` scored by the model saved in ``run``, without training.

    Adds the months the run does not know (see ``add_months``), then writes the live files
    below ``out``. ``unseen`` names the features of the month that the model was not trained on.
    """
    model, names = boosting.load_model(spark, f"{run}/model")
    grid = add_months(spark, run, tables, cfg, again_from)
    usage_long = spark.read.parquet(f"{run}/usage_long")
    segments = sinks.read_segments(spark, f"{run}/segments") if tables.account_state is not None else None
    live = forecast(model, names, read_tier_days(spark, run), usage_long, segments, grid, cfg, read_facts(spark, run))
    write_live(live, out)
    return live
