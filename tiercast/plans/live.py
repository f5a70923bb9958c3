"""Scoring the newest complete month with a trained model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import iso_day, month_label
from tiercast.operators import attribution, boosting, calendar, importance, matrix, population, signatures
from tiercast.operators.population import KEYS
from tiercast.sources.storage import write_through

# The saved nodes carry a fold; the single live model is fold 0.
_LIVE = 0


@dataclass(frozen=True)
class Forecast:
    scores: DataFrame  # user_id, snapshot_t, forecast_probability
    ranking: DataFrame  # rank, sub_feature, mean_abs_shap
    unseen: DataFrame  # sub_feature
    summary: DataFrame  # one row


def live_matrix(
    personas: DataFrame,
    grid: DataFrame,
    segments: DataFrame | None,
    usage_long: DataFrame,
    names: list[str],
    cfg: PanelConfig,
) -> DataFrame:
    """At-risk users of the live snapshot with exactly the trained feature columns."""
    cohort = live_cohort(personas, grid, segments, cfg)
    return matrix.feature_matrix(cohort, live_usage(usage_long, grid), names)


def live_cohort(
    personas: DataFrame, grid: DataFrame, segments: DataFrame | None, cfg: PanelConfig, facts: DataFrame | None = None
) -> DataFrame:
    """(user_id, snapshot_t) of the at-risk users of the live snapshot."""
    return population.live_population(personas, grid, segments, cfg, facts).filter("at_risk").select(*KEYS)


def live_usage(usage_long: DataFrame, grid: DataFrame) -> DataFrame:
    """The windowed usage of the live snapshot; the other snapshots' folders are not read."""
    return calendar.on_days(usage_long, "snapshot_t", calendar.live_snapshot(grid).select("snapshot_t"))


def forecast(
    model: GBTClassificationModel,
    names: list[str],
    personas: DataFrame,
    usage_long: DataFrame,
    segments: DataFrame | None,
    grid: DataFrame,
    cfg: PanelConfig,
    facts: DataFrame | None = None,
) -> Forecast:
    """Probabilities, attribution ranking and summary; empty tables for an empty cohort.

    ``facts`` as in ``panel_frame``.
    """
    spark = usage_long.sparkSession
    features = matrix.feature_table(spark, names)
    cohort = live_cohort(personas, grid, segments, cfg, facts)
    rows = matrix.sparse_rows(cohort, live_usage(usage_long, grid), features, len(names))
    rows = write_through(rows.withColumn("fold", F.lit(_LIVE)), "live-rows")
    nodes = boosting.tree_nodes(spark, {_LIVE: model})
    tables = signatures.signatures(nodes)
    if tables:
        scored = signatures.score(rows.withColumnRenamed("fold", "model"), tables, "forecast_probability")
        phi = signatures.attribute(rows, tables, features)
    else:
        scored = boosting.score(rows.drop("fold"), model, "forecast_probability")
        phi = attribution.attribute(rows, attribution.leaf_table(nodes), features)
    scored = write_through(scored, "live-scores")
    ranking = importance.live_ranking(importance.mean_abs(phi, rows, features))
    if rows.isEmpty():
        ranking = ranking.limit(0)

    present = matrix.feature_list(matrix.at_risk_usage(live_usage(usage_long, grid), rows))
    live = grid.filter("is_live").agg(F.struct(
        F.max("snapshot_t").alias("t"), F.max("check_day").alias("c"), F.bool_or("is_training").alias("known")))
    summary = scored.agg(
        F.count("*").alias("n_at_risk"), F.avg("forecast_probability").alias("mean_probability")
    ).withColumn("_live", live.scalar())
    return Forecast(
        scores=scored.select(*KEYS, "forecast_probability"),
        ranking=ranking,
        unseen=matrix.unseen_features(present, features),
        summary=summary.select(
            F.col("_live.t").alias("snapshot_t"),
            month_label(F.col("_live.t")).alias("month"),
            iso_day(F.col("_live.c")).alias("check_day"),
            F.col("_live.known").alias("outcome_known"),
            "n_at_risk",
            "mean_probability",
        ),
    )
