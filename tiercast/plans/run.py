"""One complete run: calendar, panel, training, rankings, forecast, files, report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import safe_date
from tiercast.operators import boosting, calendar, clean, metrics, population
from tiercast.plans.live import Forecast, forecast
from tiercast.plans.panel import Panel, build_panel
from tiercast.plans.training import TrainingRun
from tiercast.sources import metadata, sinks
from tiercast.sources.storage import write_through


@dataclass(frozen=True)
class PanelTables:
    """The inputs of a run; ``account_state`` may be missing without a segment restriction."""

    usage: DataFrame
    catalog: DataFrame
    personas: DataFrame
    account_state: DataFrame | None = None


def plan_calendar(tables: PanelTables, cfg: PanelConfig) -> tuple[DataFrame, DataFrame]:
    """(horizon, grid), the grid fixed for the rest of the run."""
    horizon = calendar.data_horizon(tables.usage, tables.personas, cfg)
    return horizon, calendar.pin(calendar.snapshot_grid(horizon, cfg))


def _tall(row: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row frame of numbers as (metric, value) rows."""
    pairs = F.array(
        *[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    )
    return row.select(F.explode(pairs).alias("m")).select("m.*")


def _day_number(day: Column) -> Column:
    """A day as the number yyyymmdd."""
    return F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)


def run_metrics(
    run: TrainingRun, tables: PanelTables, live: Forecast | None = None, horizon: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """The run report as (metric, value) rows; days are numbers yyyymmdd, flags 0 or 1.

    ``facts`` as in ``panel_frame``.
    """
    cfg, panel = run.cfg, run.panel
    facts = population.user_facts(tables.personas, cfg.flag_columns) if facts is None else facts
    folds = run.fold_metrics().agg(
        F.avg("train_auc").alias("train_auc"),
        F.avg("validation_auc").alias("validation_auc"),
        F.avg("gap").alias("gap"),
    )
    parts = [
        _tall(population.exclusion_counts(tables.personas, cfg.flag_columns, facts), "users_"),
        _tall(facts.agg(_day_number(F.min("joined")).alias("first_day"), _day_number(F.max("last_day")).alias("last_day")), "tiers_"),
        _tall(clean.count_rows(panel.usage_long, n_features="sub_feature", n_users="user_id", n_snapshots="snapshot_t"), "usage_"),
        _tall(panel.grid.agg(
            F.count_if("is_training").alias("available"),
            F.least(F.count_if("is_training"), F.lit(cfg.training_months)).alias("used")), "snapshots_"),
        _tall(clean.count_rows(panel.rows, n_users="user_id"), "panel_"),
        _tall(clean.count_rows(run.holdout[0], n_users="user_id"), "pool_"),
        _tall(clean.count_rows(run.holdout[1], n_users="user_id").select("n_users"), "test_"),
        _tall(metrics.base_rate(panel.rows).select("n_pos", "base_rate"), "panel_"),
        _tall(run.oof_metrics().select("roc_auc", "average_precision"), "oof_"),
        _tall(run.permutation_auc(), "permuted_"),
        _tall(folds, "mean_"),
        _tall(run.holdout_metrics(), "test_"),
    ]
    if panel.segments is not None:
        counts = population.segment_counts(panel.segments)
        parts.append(counts.select(
            F.concat(F.lit("segment_"), "customer_segment").alias("metric"), F.col("n_rows").cast("double").alias("value")))
        days = calendar.segment_days(panel.grid)
        parts.append(_tall(population.segment_coverage(tables.personas, panel.segments, days), "segment_"))
    if live is not None:
        numbers = live.summary.select("n_at_risk", "mean_probability", F.col("outcome_known").cast("int").alias("outcome_known"))
        parts.append(_tall(numbers, "live_"))
        parts.append(_tall(live.unseen.agg(F.count("*").alias("n_unseen_features")), "live_"))
    if horizon is not None:
        parts.append(_tall(horizon.select(F.col("is_stale").cast("int").alias("is_stale")), "tiers_"))
    constants = {
        "panel_n_features_listed": panel.n_listed, "panel_n_features": len(panel.names), "fit_rows_per_task": cfg.fit_rows_per_task}
    report = run.spark.createDataFrame([(k, float(v)) for k, v in constants.items()], "metric string, value double")
    for part in parts:
        report = report.unionByName(part)
    return report


def write_live(live: Forecast, out: str) -> None:
    """The forecast's files: scores, ranking, summary and the features the model never saw."""
    sinks.write_csv(live.ranking.orderBy("rank").drop("rank"), f"{out}/live_importance", single_file=True)
    sinks.write_csv(live.scores, f"{out}/live_scores")
    sinks.write_csv(live.summary, f"{out}/live_summary", single_file=True)
    sinks.write_csv(live.unseen, f"{out}/live_unseen_features", single_file=True)


def write_outputs(run: TrainingRun, live: Forecast, out: str) -> None:
    """The result files below ``out``; rankings are single files, row-level tables are not."""
    ranking = run.ranking.orderBy("rank")
    sinks.write_csv(ranking.drop("rank"), f"{out}/importance", single_file=True)
    top = ranking.filter(F.col("rank") <= run.cfg.top_n)
    sinks.write_csv(top.drop("rank"), f"{out}/importance_top", single_file=True)
    sinks.write_csv(
        run.ranking_by_snapshot().drop("rank"), f"{out}/importance_by_snapshot", single_file=True
    )
    sinks.write_csv(run.attribution_per_row(), f"{out}/attribution_per_row")
    write_live(live, out)
    boosting.save_model(run.final_model, run.panel.names, f"{out}/model")


def _month() -> Column:
    return F.date_format(safe_date(F.col("score_date")), "yyyy-MM")


def write_personas(personas: DataFrame, run: str, since: dt.date | None = None) -> None:
    """The tier history by month; with ``since``, only that day's month and later ones, and rows without a readable day."""
    rows = personas.withColumn("tier_month", _month())
    if since is None:
        sinks.write_parquet(rows, f"{run}/personas", "tier_month")
        return
    known = F.coalesce(F.col("tier_month") < f"{since:%Y-%m}", F.lit(False))
    sinks.add_parquet(rows.filter(~known), f"{run}/personas", "tier_month")


def read_personas(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.parquet(f"{run}/personas").drop("tier_month")


def _kept_from(spark: SparkSession, run: str, since: dt.date | None) -> DataFrame:
    """The run's copy of the tier history, from the month of ``since`` on: older folders are not read."""
    kept = spark.read.parquet(f"{run}/personas")
    return kept if since is None else kept.filter(F.col("tier_month") >= f"{since:%Y-%m}")


def write_facts(spark: SparkSession, run: str, cfg: PanelConfig, since: dt.date | None = None) -> None:
    """Per-user facts by month from the run's copy of the tier history.

    A month's folder depends on that month alone. With ``since``, only that
    day's month and later ones are read and replaced; readers merge the months.
    """
    kept = _kept_from(spark, run, since).dropna(subset=["tier_month"])
    facts = population.monthly_facts(kept, cfg.flag_columns).repartitionByRange("tier_month", "user_id")
    (sinks.write_parquet if since is None else sinks.add_parquet)(facts, f"{run}/user_facts", "tier_month")


def read_spans(spark: SparkSession, run: str) -> DataFrame:
    """First and last tier days (joined, last_day) by user and month: the horizon needs no more, and no merge by user."""
    return spark.read.parquet(f"{run}/user_facts").select("joined", "last_day")


def read_facts(spark: SparkSession, run: str) -> DataFrame:
    """One row per user of the tier history: joined, last_day, ever_flagged."""
    return population.merged_facts(spark.read.parquet(f"{run}/user_facts"))


def write_tier_days(spark: SparkSession, run: str, grid: DataFrame, since: dt.date | None = None) -> None:
    """The tier rows of the grid's days, a folder each; with ``since``, days of that month and later ones only.

    The copy lies by month, so a task that reads a part of it meets few days: the rows need no shuffle.
    """
    rows = population.rows_on_grid(_kept_from(spark, run, since), grid).withColumn("tier_day", F.col("score_date"))
    (sinks.write_parquet if since is None else sinks.add_parquet)(rows, f"{run}/tier_days", "tier_day")


def read_tier_days(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.parquet(f"{run}/tier_days").drop("tier_day")


def prepare_run(spark: SparkSession, tables: PanelTables, cfg: PanelConfig, out: str) -> tuple[Panel, DataFrame]:
    """Metadata, tiers, windowed usage and segments below ``out``; the panel over them, and the horizon.

    The tier history is read once, to copy it; the copy is read for the per-user
    facts and for the rows of the grid's days, which serve everything else.
    """
    write_personas(tables.personas, out)
    write_facts(spark, out, cfg)
    facts = read_facts(spark, out)
    horizon = write_through(calendar.horizon_of(calendar.last_event(tables.usage, cfg), read_spans(spark, out)), "horizon")
    grid = calendar.pin(calendar.snapshot_grid(horizon, cfg))
    metadata.write_metadata(metadata.run_metadata(grid, horizon, cfg), f"{out}/metadata")
    metadata.read_metadata(spark, f"{out}/metadata")  # warns when the tier history is stale
    write_tier_days(spark, out, grid)
    tiers = read_tier_days(spark, out)
    return build_panel(grid, tiers, tables.usage, tables.catalog, tables.account_state, cfg, keep=out, facts=facts), horizon


def run_panel(spark: SparkSession, tables: PanelTables, cfg: PanelConfig, out: str) -> DataFrame:
    """Everything, with its files below ``out``; returns the run report."""
    panel, horizon = prepare_run(spark, tables, cfg, out)
    run = TrainingRun(panel, cfg)
    tiers, facts = read_tier_days(spark, out), read_facts(spark, out)
    live = forecast(run.final_model, panel.names, tiers, panel.usage_long, panel.segments, panel.grid, cfg, facts)
    write_outputs(run, live, out)
    report = run_metrics(run, replace(tables, personas=tiers), live, horizon, facts)
    sinks.write_csv(report, f"{out}/run_metrics", single_file=True)
    return report


def score_month(spark: SparkSession, run: str, cfg: PanelConfig, out: str) -> Forecast:
    """The live month scored again from what a run left in its folder ``run``, without training.

    Reads metadata, tiers, windowed usage, segments and model; writes the live files below ``out``.
    """
    grid = calendar.pin(metadata.grid_from_metadata(metadata.read_metadata(spark, f"{run}/metadata")))
    segments = sinks.read_segments(spark, f"{run}/segments") if cfg.restrict_segment else None
    model, names = boosting.load_model(spark, f"{run}/model")
    usage_long = spark.read.parquet(f"{run}/usage_long")
    live = forecast(model, names, read_tier_days(spark, run), usage_long, segments, grid, cfg, read_facts(spark, run))
    write_live(live, out)
    return live
