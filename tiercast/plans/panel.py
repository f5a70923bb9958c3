"""From domain tables to model rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import sanitize_name
from tiercast.operators import calendar, matrix, population, usage as usage_ops
from tiercast.operators.population import KEYS
from tiercast.sources import sinks
from tiercast.sources.storage import side_by_side, spread, write_through


@dataclass(frozen=True)
class Panel:
    """The labelled rows of the training snapshots and what they were made from."""

    grid: DataFrame
    segments: DataFrame | None
    usage_long: DataFrame
    training_usage: DataFrame  # usage_long of the training snapshots
    frame: DataFrame
    n_listed: int  # features before the exclusion
    names: list[str]
    rows: DataFrame  # user_id, snapshot_t, engaged, x (sparse)

    def features(self) -> DataFrame:
        return matrix.feature_table(self.rows.sparkSession, self.names)


def nonzero_values(usage_long: DataFrame, rows: DataFrame) -> DataFrame:
    """The logged feature values of ``rows`` that are not 0, in long form."""
    return (
        usage_long.join(spread(rows.select(*KEYS)), KEYS, "left_semi")
        .groupBy(*KEYS, sanitize_name(F.col("sub_feature")).alias("sub_feature"))
        .agg(F.log1p(F.sum("early_events").cast("double")).alias("value"))
    )


def build_panel(
    grid: DataFrame,
    personas: DataFrame,
    usage: DataFrame,
    catalog: DataFrame,
    account_state: DataFrame | None,
    cfg: PanelConfig,
    keep: str | None = None,
    facts: DataFrame | None = None,
) -> Panel:
    """Segments, windowed usage, panel frame, feature list and model rows.

    Segments, usage, frame and rows are each read several times downstream, so
    each is written to the shared folder once and read back from there. With
    ``keep``, segments and usage are written below it instead, and stay. ``facts``
    as in ``panel_frame``.
    """

    def segment_table() -> DataFrame | None:
        if account_state is None:
            return None
        days = calendar.segment_days(grid)
        segments = population.segment_at_snapshot(personas, account_state, days)
        if keep is None:
            return write_through(segments, "segments")
        sinks.write_segments(segments, f"{keep}/segments")
        return sinks.read_segments(grid.sparkSession, f"{keep}/segments")

    def usage_table() -> DataFrame:
        # One folder per snapshot: training and scoring read the folders of their own days.
        windowed = sinks.by_snapshot(usage_ops.windowed_usage(usage, grid, catalog, cfg))
        if keep is None:
            return write_through(windowed, "usage-long", "snapshot_t")
        sinks.write_parquet(windowed, f"{keep}/usage_long", "snapshot_t")
        return grid.sparkSession.read.schema(windowed.schema).parquet(f"{keep}/usage_long")

    segments, usage_long = side_by_side(grid.sparkSession, segment_table, usage_table)
    training = calendar.recent(grid, cfg.training_months)
    training_usage = calendar.on_days(usage_long, "snapshot_t", training.select("snapshot_t"))
    frame = write_through(population.panel_frame(personas, training, segments, cfg, facts=facts), "frame")
    at_risk = population.at_risk_rows(frame)
    listed = write_through(matrix.feature_list(matrix.at_risk_usage(training_usage, at_risk)), "features")
    kept = write_through(matrix.model_features(listed, cfg), "model-features")
    names = matrix.feature_names(kept)
    if not names:
        raise ValueError("no feature left: the at-risk rows have no usage in scope")
    labelled = frame.filter("at_risk").select(*KEYS, "engaged")
    rows = write_through(matrix.sparse_rows(labelled, training_usage, kept, len(names)), "rows")
    return Panel(grid, segments, usage_long, training_usage, frame, listed.count(), names, rows)
