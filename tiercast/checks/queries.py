"""One query per operator, over the whole test tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tiercast.checks import fixed_model
from tiercast.functions.columns import iso_day, month_label, quoted, sanitize_name
from tiercast.operators import (
    attribution, calendar, clean, importance, matrix, metrics, population, signatures, splits, usage as usage_ops,
)
from tiercast.operators.boosting import model_rows
from tiercast.operators.population import KEYS
from tiercast.plans.live import Forecast, forecast, live_matrix
from tiercast.plans.panel import Panel, build_panel, nonzero_values
from tiercast.plans.refresh import add_months
from tiercast.plans.run import PanelTables, prepare_run, read_facts, read_personas, read_tier_days, run_metrics
from tiercast.plans.training import TrainingRun
from tiercast.sources import metadata
from tiercast.sources.sinks import read_segments
from tiercast.sources.storage import fingerprint, fresh_path, spread, write_through
from tiercast.sources.tables import ingest_personas, scan
from tiercast.sources.testdata import INPUTS, TEST_CONFIG, domain_tables

COHORT_SINCE = dt.date(1997, 1, 1)
SCAN_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]


class Workspace:
    """The test tables of one folder as domain tables, and frames derived from them."""

    cfg = TEST_CONFIG

    def __init__(self, spark: SparkSession, sf_dir: str, version: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = domain_tables(spark, sf_dir, version)

    @cached_property
    def horizon(self) -> DataFrame:
        return calendar.data_horizon(self.tables.usage, self.tables.personas, self.cfg)

    @property
    def lazy_grid(self) -> DataFrame:
        return calendar.snapshot_grid(self.horizon, self.cfg)

    @cached_property
    def grid(self) -> DataFrame:
        return calendar.pin(self.lazy_grid)

    # --- operators on the domain tables -----------------------------------

    def segments(self) -> DataFrame:
        t = self.tables
        return population.segment_at_snapshot(t.personas, t.account_state, calendar.segment_days(self.grid))

    def usage_long(self) -> DataFrame:
        return usage_ops.windowed_usage(self.tables.usage, self.grid, self.tables.catalog, self.cfg)

    def frame(self, **changes) -> DataFrame:
        cfg = replace(self.cfg, **changes)
        training = calendar.recent(self.grid, cfg.training_months)
        return population.panel_frame(self.tables.personas, training, self.panel.segments, cfg)

    # --- operators on the panel, whose parts are written once --------------

    @cached_property
    def panel(self) -> Panel:
        t = self.tables
        return build_panel(self.grid, t.personas, t.usage, t.catalog, t.account_state, self.cfg)

    def at_risk(self) -> DataFrame:
        return population.at_risk_rows(self.panel.frame)

    def at_risk_usage(self) -> DataFrame:
        return matrix.at_risk_usage(self.panel.training_usage, self.at_risk())

    def features(self) -> DataFrame:
        return matrix.feature_list(self.at_risk_usage())

    @cached_property
    def names(self) -> list[str]:
        return matrix.feature_names(self.features())

    def training_set(self) -> DataFrame:
        return matrix.training_set(self.panel.frame, self.panel.training_usage, self.panel.names)

    def live_cohort(self) -> DataFrame:
        return population.live_population(self.tables.personas, self.grid, self.panel.segments, self.cfg)

    def live_features(self) -> DataFrame:
        cohort = self.live_cohort().filter("at_risk")
        return matrix.feature_list(matrix.at_risk_usage(self.panel.usage_long, cohort))

    # --- surrogates: scores and attributions that need no model ----------

    def surrogate_scores(self) -> DataFrame:
        """A score with many ties: the log of a row's events, shifted by user."""
        return self._surrogate_scores

    @cached_property
    def _surrogate_scores(self) -> DataFrame:
        events = self.panel.usage_long.groupBy(*KEYS).agg(F.sum("early_events").alias("n"))
        value = F.log(1 + F.coalesce("n", F.lit(0))) + (F.col("user_id") % 7) / 10
        scored = self.at_risk().join(spread(events), KEYS, "left").select(
            *KEYS, "engaged", F.round(value, 2).alias("score")
        )
        return write_through(scored, "surrogate-scores")  # metrics read scores twice: for buckets and for points

    @cached_property
    def surrogate_phi(self) -> DataFrame:
        """Centred feature values, with the sign turned for names of odd length."""
        # Written as rows: the mean and the cells each read them.
        cells = write_through(self.training_set(), "surrogate-rows").unpivot(
            KEYS, [F.col(quoted(n)) for n in self.panel.names], "sub_feature", "n"
        ).withColumn("value", F.log1p(F.col("n").cast("double")))
        centre = cells.groupBy("sub_feature").agg(F.avg("value").alias("centre"))
        sign = F.when(F.length("sub_feature") % 2 == 0, 1.0).otherwise(-1.0)
        phi = cells.join(F.broadcast(centre), "sub_feature").select(  # as long as the names on the driver
            *KEYS, "sub_feature", "value", ((F.col("value") - F.col("centre")) * sign).alias("phi")
        )
        return write_through(phi, "surrogate-phi")

    def surrogate_gain(self) -> DataFrame:
        """Users per feature."""
        used = self.surrogate_phi.filter("value > 0")
        return used.groupBy("sub_feature").agg(F.count_distinct("user_id").cast("double").alias("gain"))

    def model_feature_table(self) -> DataFrame:
        return self.panel.features()

    def surrogate_direction(self) -> DataFrame:
        phi = self.surrogate_phi
        values = phi.filter("value > 0").select("sub_feature", "value")
        return importance.direction(phi, values, self.at_risk(), self.model_feature_table())

    def surrogate_ranking(self) -> DataFrame:
        means = importance.mean_abs(self.surrogate_phi, self.at_risk(), self.model_feature_table())
        return importance.importance_table(means, self.surrogate_gain(), self.surrogate_direction())

    def surrogate_by_snapshot(self) -> DataFrame:
        return importance.by_snapshot(
            self.surrogate_phi, self.at_risk(), self.model_feature_table(), self.cfg.top_n
        )

    # --- a run over older tables, brought up to date ------------------------

    @cached_property
    def refreshed(self) -> str:
        """The folder of a run whose tables ended 70 days earlier, after the months since were added."""
        t, out = self.tables, fresh_path(self.spark, "run")
        last = F.lit(self.horizon.first().data_max - dt.timedelta(days=70))
        older = PanelTables(
            t.usage.filter(F.col("time_period") <= last), t.catalog, t.personas.filter(F.col("score_date") <= last),
            t.account_state.filter(F.col("date") <= last))
        prepare_run(self.spark, older, self.cfg, out)
        add_months(self.spark, out, PanelTables(t.usage, t.catalog, t.personas, t.account_state), self.cfg)
        return out

    def new_month_scores(self) -> DataFrame:
        """The live month from the refreshed folder, scored by the fixed model of fold 0."""
        grid = calendar.pin(metadata.grid_from_metadata(metadata.read_metadata(self.spark, f"{self.refreshed}/metadata")))
        segments = read_segments(self.spark, f"{self.refreshed}/segments")
        usage_long = self.spark.read.parquet(f"{self.refreshed}/usage_long")
        wide = live_matrix(read_personas(self.spark, self.refreshed), grid, segments, usage_long, self.panel.names, self.cfg)
        rows = write_through(model_rows(wide, self.panel.names).withColumn("model", F.lit(0)), "new-month-rows")
        return signatures.score(rows, self.fixed_tables, "forecast_probability").drop("model")

    # --- a model that is written down, over the panel's rows ---------------

    @cached_property
    def fixed_nodes(self) -> DataFrame:
        return fixed_model.nodes(self.spark)

    @cached_property
    def fixed_tables(self) -> signatures.Signatures:
        return signatures.signatures(self.fixed_nodes)

    @cached_property
    def folded(self) -> DataFrame:
        """The training rows with their fold."""
        return write_through(splits.group_folds(self.panel.rows, self.cfg.n_folds, self.cfg.seed), "folded")

    @cached_property
    def fixed_scores(self) -> DataFrame:
        return write_through(signatures.out_of_fold(self.folded, self.fixed_tables), "fixed-scores")

    @cached_property
    def fixed_phi(self) -> DataFrame:
        return write_through(signatures.attribute(self.folded, self.fixed_tables, self.model_feature_table()), "fixed-phi")

    def fixed_means(self) -> DataFrame:
        return importance.mean_abs(self.fixed_phi, self.panel.rows, self.model_feature_table())

    # --- model-bound parts, fitted once ----------------------------------

    @cached_property
    def run(self) -> TrainingRun:
        return TrainingRun(self.panel, self.cfg)

    @cached_property
    def live(self) -> Forecast:
        p = self.panel
        return forecast(
            self.run.final_model, p.names, self.tables.personas, p.usage_long, p.segments, p.grid, self.cfg
        )

    def report(self) -> DataFrame:
        t = self.tables
        return run_metrics(
            self.run, PanelTables(t.usage, t.catalog, t.personas, t.account_state), self.live, self.horizon
        )


# --- sources and calendar -----------------------------------------------------


def raw_personas(w: Workspace) -> DataFrame:
    """A table with the tier source's columns, filled from the test personas."""
    u, day, tier = F.col("user_id"), F.col("score_date"), F.col("user_category_persona")
    eighth = (u % 8) / 8
    return w.tables.personas.select(
        "user_id", "acct_id", day.alias("time_period"), (tier == "Inactive").alias("pre_activity"),
        F.datediff(day, F.lit(dt.date(1995, 1, 1))).alias("tenure_days"),
        F.date_sub(day, 1).alias("last_active"), (u % 30).alias("days_since_active"),
        tier.alias("user_category"), F.concat(F.lit("tier "), tier).alias("reason"),
        ((u % 64) / 64).alias("user_category_score"),
        ((u % 16) / 16).alias("user_category_percentile_compared_to_peers"),
        tier.alias("usage_persona"), (u % 5).alias("usage_depth"), eighth.alias("usage_depth_pct"),
        tier.alias("login_frequency_persona"), (F.month(day) / 4).alias("active_days_ratio"),
        (1 - eighth).alias("active_days_ratio_pct"), tier.alias("feature_persona"),
        (u % 3).alias("breadth_ratio"), (eighth / 2).alias("breadth_ratio_pct"),
    )


def run_metadata(w: Workspace) -> DataFrame:
    document = metadata.run_metadata(w.grid, w.horizon, w.cfg)
    return document.withColumn("snapshots", F.to_json("snapshots"))


def scan_project(w: Workspace) -> DataFrame:
    return scan(w.spark, f"{w.sf_dir}/orders.parquet", SCAN_COLUMNS)


def date_labels(w: Workspace) -> DataFrame:
    t = F.col("snapshot_t")
    return w.lazy_grid.select(iso_day(t).alias("iso"), month_label(t).alias("label"))


def safe_dates(w: Workspace) -> DataFrame:
    """Order days as text, some of them spoiled."""
    text = (
        F.when(F.col("o_orderkey") % 10 == 0, "2024-13-01")
        .when(F.col("o_orderkey") % 10 == 1, "n/a")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    orders = scan(w.spark, f"{w.sf_dir}/orders.parquet", ["o_orderkey", "o_orderdate"])
    return clean.safe_dates(orders.select("o_orderkey", text.alias("score_date")), "score_date")


def dedup_first(w: Workspace) -> DataFrame:
    return clean.dedup_first(
        w.tables.usage, ["user_id", "time_period"], ["product", "feature", "sub_feature"]
    )


def sanitize_names(w: Workspace) -> DataFrame:
    parts = scan(w.spark, f"{w.sf_dir}/part.parquet", ["p_partkey", "p_brand", "p_type"])
    kind = F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit(" ["), "p_brand", F.lit("] ")))
        .when(kind == 1, "   ")
        .when(kind == 2, F.concat(F.lit("<"), "p_type", F.lit(">")))
        .otherwise(F.col("p_type"))
    )
    return parts.select("p_partkey", sanitize_name(name).alias("sub_feature"))


def window_range_join(w: Workspace) -> DataFrame:
    return usage_ops.window_range_join(w.tables.usage, w.grid, w.cfg).drop("window_start")


def window_range_join_weekly(w: Workspace) -> DataFrame:
    """The same join on a grid of overlapping 7-day windows, one per day of the events."""
    cfg = replace(w.cfg, window_days=7)
    events = scan(w.spark, f"{w.sf_dir}/events.parquet", ["user_id", "ts", "event_type"]).select(
        "user_id", "event_type", F.to_date("ts").alias("time_period")
    )
    span = events.agg(F.min("time_period").alias("lo"), F.max("time_period").alias("hi"))
    t = F.col("snapshot_t")
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("snapshot_t")).select(
        "snapshot_t", F.date_sub(t, 6).alias("window_start")
    )
    return (
        usage_ops.window_range_join(events, grid, cfg)
        .groupBy("user_id", "snapshot_t", "event_type")
        .agg(F.count("*").alias("n_events"))
    )


def at_risk_cohort(w: Workspace) -> DataFrame:
    return population.at_risk_rows(w.frame(joined_since=COHORT_SINCE)).drop("engaged")


def sparse_matrix(w: Workspace) -> DataFrame:
    packed = matrix.sparse_matrix(w.at_risk().drop("engaged"), w.panel.usage_long, w.features())
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("indices", "values")]
    return packed.select(*KEYS, *joined)


def run_counts(w: Workspace) -> DataFrame:
    return clean.count_rows(
        w.panel.usage_long, n_features="sub_feature", n_users="user_id", n_snapshots="snapshot_t"
    )


def _packed(wide: DataFrame, names: list[str], scale: int | None = None) -> DataFrame:
    """The named columns as one text per row, in order; scaled values as rounded whole numbers."""
    cells = [F.col(quoted(n)) for n in names]
    cells = [F.round(c * scale).cast("bigint") for c in cells] if scale else cells
    carried = [c for c in wide.columns if c not in set(names)]
    return wide.select(*carried, F.array_join(F.array(*[c.cast("string") for c in cells]), ",").alias("cells"))


def wide_features(w: Workspace) -> DataFrame:
    return matrix.feature_matrix(w.at_risk().drop("engaged"), w.panel.training_usage, w.names)


def feature_matrix(w: Workspace) -> DataFrame:
    return _packed(wide_features(w), w.names)


def log_features(w: Workspace) -> DataFrame:
    wide = matrix.log_features(w.training_set().drop("engaged"), w.panel.names)
    return _packed(wide, w.panel.names, 1_000_000)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def surrogate_auc_by_snapshot(w: Workspace) -> DataFrame:
    scored = w.surrogate_scores()
    return _rounded(metrics.ranking_metrics(scored, ["snapshot_t"]), "roc_auc", "average_precision")


def align_features(w: Workspace) -> DataFrame:
    return matrix.align_features(w.live_features(), w.model_feature_table())


def unseen_features(w: Workspace) -> DataFrame:
    return matrix.unseen_features(w.live_features(), w.model_feature_table())


def wide_live(w: Workspace) -> DataFrame:
    p = w.panel
    return live_matrix(w.tables.personas, w.grid, p.segments, p.usage_long, p.names, w.cfg)


def _live_matrix(w: Workspace) -> DataFrame:
    return _packed(wide_live(w), w.panel.names)


# --- a fixed model: scores, attributions and rankings that SQL repeats ---------


def fixed_tree_in_sample(w: Workspace) -> DataFrame:
    scored = signatures.in_sample(w.folded, w.fixed_tables, w.cfg.n_folds)
    return scored.select(*KEYS, "engaged", "fold", F.round("score", 9).alias("score"))


def fixed_tree_fold_metrics(w: Workspace) -> DataFrame:
    scored = _rounded(signatures.in_sample(w.folded, w.fixed_tables, w.cfg.n_folds), "score")
    return _rounded(metrics.ranking_metrics(scored, ["fold"]), "roc_auc", "average_precision")


def _cells(phi: DataFrame) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("value", "phi")]
    return phi.select(*KEYS, "sub_feature", *rounded).filter("phi <> 0")


def fixed_tree_attribution_by_leaf(w: Workspace) -> DataFrame:
    return _cells(attribution.attribute(w.folded, attribution.leaf_table(w.fixed_nodes), w.model_feature_table()))


def fixed_tree_importance(w: Workspace) -> DataFrame:
    features, rows = w.model_feature_table(), w.panel.rows
    values = nonzero_values(w.panel.training_usage, rows)
    return importance.importance_table(
        w.fixed_means(), importance.gain(w.fixed_nodes, features, w.cfg.n_folds),
        importance.direction(w.fixed_phi, values, rows, features))


def fixed_tree_per_row(w: Workspace) -> DataFrame:
    """The wide table of the twelve best features, its attributions as one text."""
    best = [r.sub_feature for r in importance.ranked(w.fixed_means()).limit(12).collect()]
    wide = importance.per_row(w.fixed_scores, w.fixed_phi, best)
    packed = _packed(wide, [f"shap__{n}" for n in best], 1_000_000)
    return packed.withColumn("engaged_probability", F.round("engaged_probability", 9))


# --- model-bound: what can be told of a fit without repeating it ---------------


def _share(column: str):
    """True for a proportion; null stays null."""
    return F.col(column).between(0.0, 1.0).alias(column)


def oof_scores_holds(w: Workspace) -> DataFrame:
    return w.run.oof.scored.select(*KEYS, "engaged", "fold", _share("score"))


def oof_metrics_holds(w: Workspace) -> DataFrame:
    return w.run.oof_metrics().select("n_rows", _share("roc_auc"), _share("average_precision"))


def permutation_auc_holds(w: Workspace) -> DataFrame:
    """The shuffled labels have as many positives as the labels; their score is a proportion."""
    labels = w.run.permuted.scored.agg(F.count("*").alias("n_rows"), F.sum("engaged").alias("n_pos"))
    share = w.run.permutation_auc().select(_share("roc_auc"))
    both = labels.unionByName(share, allowMissingColumns=True)  # one row each
    return both.agg(F.max("n_rows").alias("n_rows"), F.max("n_pos").alias("n_pos"), F.max("roc_auc").alias("roc_auc"))


def fold_metrics_holds(w: Workspace) -> DataFrame:
    """Per fold: its rows, and that gap = train - validation, with both in range where defined."""
    rows = w.run.pool.scored.groupBy("fold").agg(F.count("*").alias("n_rows"))
    gap = F.abs(F.col("gap") - (F.col("train_auc") - F.col("validation_auc"))) < 1e-12
    sound = gap & F.col("train_auc").between(0, 1) & F.col("validation_auc").between(0, 1)
    return rows.join(w.run.fold_metrics().select("fold", F.coalesce(sound, F.lit(True)).alias("sound")), "fold")


def holdout_metrics_holds(w: Workspace) -> DataFrame:
    return w.run.holdout_metrics().select("n_rows", F.round("base_rate", 6).alias("base_rate"))


def gain_importance_holds(w: Workspace) -> DataFrame:
    return w.run.gain_importance().select("sub_feature", (F.col("gain") >= 0).alias("not_negative"))


def oof_attribution_holds(w: Workspace) -> DataFrame:
    """Per row: its attributions and the base value of its fold's model add up to the model's score."""
    run = w.run
    sums = run.phi.groupBy(*KEYS).agg(F.sum("phi").alias("phi"))
    log_odds = F.log(F.col("score") / (1 - F.col("score")))
    # A fold's base value is the same for all its rows: what is left after the attributions.
    left = run.oof.scored.join(spread(sums), KEYS, "left").select(
        *KEYS, "fold", (log_odds - F.coalesce("phi", F.lit(0.0))).alias("base"))
    bases = left.groupBy("fold").agg(F.min("base").alias("low"), F.max("base").alias("high"))
    return left.join(F.broadcast(bases), "fold").select(  # one row a fold
        *KEYS, "fold", (F.col("high") - F.col("low") < 1e-6).alias("adds_up"))


def model_importance_holds(w: Workspace) -> DataFrame:
    """Every feature once, ranks without gaps, in the order of the rounded means."""
    by_rank = Window.orderBy("rank")  # one row per feature
    falling = F.coalesce(F.lag("mean_abs_shap").over(by_rank) >= F.col("mean_abs_shap"), F.lit(True))
    return w.run.ranking.select(
        "sub_feature", (F.row_number().over(by_rank) == F.col("rank")).alias("in_order"), falling.alias("falling"))


def attribution_per_row_holds(w: Workspace) -> DataFrame:
    wide = w.run.attribution_per_row()
    return wide.select(*KEYS, "engaged", F.lit(len(wide.columns) - 4).alias("n_features"))


def live_scores_holds(w: Workspace) -> DataFrame:
    return w.live.scores.select(*KEYS, _share("forecast_probability"))


def live_importance_holds(w: Workspace) -> DataFrame:
    return w.live.ranking.select("sub_feature", (F.col("mean_abs_shap") >= 0).alias("not_negative"))


def live_summary_holds(w: Workspace) -> DataFrame:
    return w.live.summary.withColumn("mean_probability", _share("mean_probability"))


#: Rows of the report that do not depend on a fit.
FIT_FREE = (
    "users_n_before", "users_n_excluded", "users_n_after", "panel_n_rows", "panel_n_users", "panel_n_pos",
    "panel_n_features_listed", "panel_n_features", "usage_n_rows", "usage_n_users", "snapshots_available",
    "snapshots_used", "segment_Paid", "segment_n_matched", "segment_n_total", "live_n_at_risk", "tiers_last_day",
    "tiers_is_stale", "live_n_unseen_features", "live_outcome_known",
)


def run_metrics_holds(w: Workspace) -> DataFrame:
    return w.report().filter(F.col("metric").isin(*FIT_FREE))


QUERIES = {
    # sources and calendar
    "ingest_personas": lambda w: ingest_personas(raw_personas(w)),
    "scan_project": scan_project,
    "data_horizon": lambda w: w.horizon,
    "snapshot_grid": lambda w: w.lazy_grid,
    "training_snapshots": lambda w: calendar.training_snapshots(w.lazy_grid),
    "live_snapshot": lambda w: calendar.live_snapshot(w.lazy_grid),
    "recent_snapshots": lambda w: calendar.recent(w.lazy_grid, 4),
    "run_metadata": run_metadata,
    "date_labels": date_labels,
    # cleaning
    "safe_dates": safe_dates,
    "distinct_keys": lambda w: clean.distinct_keys(w.tables.usage, ["user_id", "time_period"]),
    "dedup_first": dedup_first,
    "sanitize_names": sanitize_names,
    # population
    "exclude_flagged_users": lambda w: population.exclude_flagged_users(
        w.tables.personas, w.cfg.flag_columns
    ).select("user_id", "score_date", "user_category_persona"),
    "exclusion_counts": lambda w: population.exclusion_counts(w.tables.personas, w.cfg.flag_columns),
    "user_join_date": lambda w: population.join_dates(w.tables.personas, w.cfg.flag_columns),
    "segment_at_snapshot": lambda w: w.segments(),
    "segment_counts": lambda w: population.segment_counts(w.panel.segments),
    "segment_coverage": lambda w: population.segment_coverage(
        w.tables.personas, w.panel.segments, calendar.segment_days(w.grid)
    ),
    "panel_frame": lambda w: w.frame(),
    "at_risk": lambda w: population.at_risk_rows(w.frame()),
    "at_risk_cohort": at_risk_cohort,
    "live_population": lambda w: w.live_cohort(),
    # usage
    "usage_scope": lambda w: usage_ops.usage_scope(w.tables.usage, w.cfg),
    "denylist_anti": lambda w: usage_ops.drop_denied(
        w.tables.usage, usage_ops.denied_table(w.spark, w.cfg)
    ),
    "window_range_join": window_range_join,
    "window_range_join_weekly": window_range_join_weekly,
    "windowed_usage": lambda w: w.usage_long(),
    "at_risk_usage": lambda w: w.at_risk_usage(),
    "run_counts": run_counts,
    # matrix
    "feature_list": lambda w: w.features(),
    "model_features": lambda w: matrix.model_features(w.features(), w.cfg),
    "feature_matrix": feature_matrix,
    "sparse_matrix": sparse_matrix,
    "training_set": lambda w: _packed(w.training_set(), w.panel.names),
    "log_features": log_features,
    "align_features": align_features,
    "unseen_features": unseen_features,
    "live_matrix": _live_matrix,
    # splits
    "group_folds": lambda w: splits.group_folds(w.at_risk(), w.cfg.n_folds, w.cfg.seed),
    "group_holdout": lambda w: splits.group_holdout(w.at_risk(), w.cfg.test_share, w.cfg.seed),
    "permute_labels": lambda w: splits.permute_labels(w.at_risk(), w.cfg.seed),
    # metrics
    "base_rate": lambda w: _rounded(metrics.base_rate(w.at_risk()), "base_rate"),
    "class_weight": lambda w: _rounded(metrics.class_weight(w.at_risk()), "pos_weight"),
    "roc_auc": lambda w: _rounded(metrics.roc_auc(w.surrogate_scores()), "roc_auc"),
    "average_precision": lambda w: _rounded(
        metrics.average_precision(w.surrogate_scores()), "average_precision"
    ),
    "metrics_by_snapshot": surrogate_auc_by_snapshot,
    # rankings on surrogate attributions
    "feature_direction": lambda w: w.surrogate_direction(),
    "feature_importance": lambda w: w.surrogate_ranking(),
    "importance_top10": lambda w: w.surrogate_ranking().filter(F.col("rank") <= w.cfg.top_n),
    "importance_by_snapshot": lambda w: w.surrogate_by_snapshot(),
    "importance_latest": lambda w: importance.latest(w.surrogate_by_snapshot()),
    # months added to an older run
    "refreshed_usage": lambda w: w.spark.read.parquet(f"{w.refreshed}/usage_long"),
    "refreshed_segments": lambda w: read_segments(w.spark, f"{w.refreshed}/segments"),
    "refreshed_personas": lambda w: read_personas(w.spark, w.refreshed),
    "refreshed_user_facts": lambda w: read_facts(w.spark, w.refreshed),
    "refreshed_tier_days": lambda w: read_tier_days(w.spark, w.refreshed),
    "refreshed_metadata": lambda w: metadata.read_metadata(w.spark, f"{w.refreshed}/metadata").withColumn(
        "snapshots", F.to_json("snapshots")),
    "new_month_scores": lambda w: w.new_month_scores().withColumn(
        "forecast_probability", F.round("forecast_probability", 9)),
    # a fixed model
    "fixed_tree_scores": lambda w: w.fixed_scores.withColumn("score", F.round("score", 9)),
    "fixed_tree_in_sample": fixed_tree_in_sample,
    "fixed_tree_metrics": lambda w: _rounded(
        metrics.ranking_metrics(_rounded(w.fixed_scores, "score")), "roc_auc", "average_precision"),
    "fixed_tree_fold_metrics": fixed_tree_fold_metrics,
    "fixed_tree_attribution": lambda w: _cells(w.fixed_phi),
    "fixed_tree_attribution_by_leaf": fixed_tree_attribution_by_leaf,
    "fixed_tree_gain": lambda w: _rounded(importance.gain(w.fixed_nodes, w.model_feature_table(), w.cfg.n_folds), "gain"),
    "fixed_tree_importance": fixed_tree_importance,
    "fixed_tree_by_snapshot": lambda w: importance.by_snapshot(
        w.fixed_phi, w.panel.rows, w.model_feature_table(), w.cfg.top_n),
    "fixed_tree_per_row": fixed_tree_per_row,
    # model-bound
    "oof_scores": lambda w: w.run.oof.scored,
    "oof_metrics": lambda w: w.run.oof_metrics(),
    "permutation_auc": lambda w: w.run.permutation_auc(),
    "fold_metrics": lambda w: w.run.fold_metrics(),
    "holdout_metrics": lambda w: w.run.holdout_metrics(),
    "gain_importance": lambda w: w.run.gain_importance(),
    "oof_attribution": lambda w: w.run.phi,
    "model_importance": lambda w: w.run.ranking,
    "attribution_per_row": lambda w: w.run.attribution_per_row(),
    "live_scores": lambda w: w.live.scores,
    "live_importance": lambda w: w.live.ranking,
    "live_summary": lambda w: w.live.summary,
    "run_metrics": lambda w: w.report(),
    # what holds for any fit of the same
    "oof_scores_holds": oof_scores_holds,
    "oof_metrics_holds": oof_metrics_holds,
    "permutation_auc_holds": permutation_auc_holds,
    "fold_metrics_holds": fold_metrics_holds,
    "holdout_metrics_holds": holdout_metrics_holds,
    "gain_importance_holds": gain_importance_holds,
    "oof_attribution_holds": oof_attribution_holds,
    "model_importance_holds": model_importance_holds,
    "attribution_per_row_holds": attribution_per_row_holds,
    "live_scores_holds": live_scores_holds,
    "live_importance_holds": live_importance_holds,
    "live_summary_holds": live_summary_holds,
    "run_metrics_holds": run_metrics_holds,
}

_workspaces: dict[tuple[str, str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this folder; a new one once the files in it have changed."""
    sf_dir = sf_dir.rstrip("/")
    version = fingerprint(spark, [f"{sf_dir}/{name}.parquet" for name in INPUTS])
    key = (spark.sparkContext.applicationId, sf_dir, version)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, sf_dir, version)
    return _workspaces[key]
