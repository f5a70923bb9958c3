"""Cross-validated training, its checks, and the rankings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, functions as F

from tiercast.config import PanelConfig
from tiercast.operators import attribution, boosting, importance, metrics, signatures, splits
from tiercast.plans.panel import Panel, nonzero_values
from tiercast.sources.storage import write_through


@dataclass(frozen=True)
class Evaluation:
    """Scores of one set of fold models; ``folded`` holds the rows with their fold."""

    folded: DataFrame
    models: dict[int, GBTClassificationModel]
    nodes: DataFrame
    tables: signatures.Signatures | None  # None if the trees are too deep for them
    scored: DataFrame


class TrainingRun:
    """The fits over one panel. Each part is computed when first asked for, and kept."""

    def __init__(self, panel: Panel, cfg: PanelConfig):
        self.panel = panel
        self.cfg = cfg
        self.spark = panel.rows.sparkSession

    @cached_property
    def pos_weight(self) -> float:
        return metrics.class_weight(self.panel.rows).first().pos_weight

    def _evaluate(self, rows: DataFrame, name: str) -> Evaluation:
        """Fold ``rows``, fit once per left-out fold, score every row out of fold."""
        folded = splits.group_folds(rows, self.cfg.n_folds, self.cfg.seed)
        # Laid out by fold: a fit reads the folders of the other folds only.
        folded = write_through(folded, f"{name}-folds", "fold")
        models = boosting.fit_folds(folded, self.pos_weight, self.cfg)
        nodes = write_through(boosting.tree_nodes(self.spark, models), f"{name}-nodes")
        tables = signatures.signatures(nodes)
        scored = signatures.out_of_fold(folded, tables) if tables else boosting.oof_scores(folded, models).drop("x")
        return Evaluation(folded, models, nodes, tables, write_through(scored, f"{name}-scores"))

    @cached_property
    def oof(self) -> Evaluation:
        return self._evaluate(self.panel.rows, "oof")

    @cached_property
    def permuted(self) -> Evaluation:
        """The same scheme on shuffled labels, with the folds dealt anew."""
        # Written, as the folds and the rows they go to each read the dealt labels.
        dealt = write_through(splits.permute_labels(self.panel.rows, self.cfg.seed), "permuted-rows")
        return self._evaluate(dealt, "permuted")

    @cached_property
    def holdout(self) -> tuple[DataFrame, DataFrame]:
        """(pool, test) rows, parted by user before any fold is drawn."""
        marked = splits.group_holdout(self.panel.rows, self.cfg.test_share, self.cfg.seed)
        marked = write_through(marked, "holdout", "is_test")
        return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")

    @cached_property
    def pool(self) -> Evaluation:
        return self._evaluate(self.holdout[0], "pool")

    @cached_property
    def final_model(self) -> GBTClassificationModel:
        """Fitted on every labelled row; scores new rows and nothing reported here."""
        return boosting.fit(self.panel.rows, self.pos_weight, self.cfg)

    # --- metrics --------------------------------------------------------

    def oof_metrics(self) -> DataFrame:
        return metrics.ranking_metrics(self.oof.scored)

    def permutation_auc(self) -> DataFrame:
        return metrics.roc_auc(self.permuted.scored)

    def fold_metrics(self) -> DataFrame:
        """Train and validation ROC-AUC of every fold of the pool, and their gap."""
        pool = self.pool
        scored = (
            signatures.in_sample(pool.folded, pool.tables, self.cfg.n_folds) if pool.tables
            else boosting.in_sample_scores(pool.folded, pool.models)
        )
        scored = write_through(scored.select("fold", "engaged", "score"), "in-sample-scores")  # read for buckets and for points
        inside = metrics.roc_auc(scored, ["fold"]).withColumnRenamed("roc_auc", "train_auc")
        outside = metrics.roc_auc(self.pool.scored, ["fold"]).withColumnRenamed("roc_auc", "validation_auc")
        return inside.join(outside, "fold").withColumn(
            "gap", F.col("train_auc") - F.col("validation_auc")
        )

    @cached_property
    def _test_scored(self) -> DataFrame:
        pool, test = self.holdout
        model = boosting.fit(pool, self.pos_weight, self.cfg)
        return write_through(boosting.score(test, model), "test-scores")

    def holdout_metrics(self) -> DataFrame:
        """One fit on the pool, one evaluation on the held-out users."""
        return metrics.ranking_metrics(self._test_scored).withColumn(
            "base_rate", metrics.base_rate(self._test_scored).select("base_rate").scalar()
        )

    # --- attribution and rankings ----------------------------------------

    @property
    def nodes(self) -> DataFrame:
        return self.oof.nodes

    @cached_property
    def phi(self) -> DataFrame:
        """Out-of-fold attributions: each row explained by its own fold's model."""
        folded, features = self.oof.folded, self.panel.features()
        cells = (
            signatures.attribute(folded, self.oof.tables, features) if self.oof.tables
            else attribution.attribute(folded, attribution.leaf_table(self.nodes), features)
        )
        return write_through(cells, "phi")

    def gain_importance(self) -> DataFrame:
        return importance.gain(self.nodes, self.panel.features(), self.cfg.n_folds)

    @cached_property
    def ranking(self) -> DataFrame:
        rows, features = self.panel.rows, self.panel.features()
        values = nonzero_values(self.panel.training_usage, rows)
        table = importance.importance_table(
            importance.mean_abs(self.phi, rows, features),
            self.gain_importance(),
            importance.direction(self.phi, values, rows, features),
        )
        return write_through(table.coalesce(1), "ranking")

    def top_features(self, n: int) -> list[str]:
        """Names of the ``n`` best features by unrounded importance."""
        means = importance.mean_abs(self.phi, self.panel.rows, self.panel.features())
        return [r.sub_feature for r in importance.ranked(means).limit(n).collect()]

    def ranking_by_snapshot(self) -> DataFrame:
        return importance.by_snapshot(
            self.phi, self.panel.rows, self.panel.features(), self.cfg.top_n
        )

    def attribution_per_row(self) -> DataFrame:
        return importance.per_row(self.oof.scored, self.phi, self.top_features(self.cfg.wide_top))
