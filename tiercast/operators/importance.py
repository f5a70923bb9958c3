"""Feature rankings from long attribution tables.

``phi`` tables hold (user_id, snapshot_t, sub_feature, value, phi); a pair that
is absent counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiercast.functions.columns import quoted
from tiercast.operators.population import KEYS
from tiercast.sources.storage import spread, write_through


def _rankable(mean: Column) -> Column:
    """Sums of doubles depend on their order in the last digits; ranks must not."""
    return F.round(mean, 12)


def mean_abs(phi: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """Mean absolute attribution of every listed feature over all rows."""
    n_rows = rows.agg(F.count("*")).scalar()
    sums = phi.groupBy("sub_feature").agg(F.sum(F.abs("phi")).alias("_s"))
    return features.select("sub_feature").join(sums, "sub_feature", "left").select(
        "sub_feature",
        F.coalesce(F.try_divide("_s", n_rows), F.lit(0.0)).alias("mean_abs_shap"),
    )


def direction(phi: DataFrame, values: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """Sign of the correlation between a feature's value and its attribution.

    0 where the value never changes; null where the attribution never does.
    ``values`` are the nonzero (sub_feature, value) pairs of the rows.
    """
    n_rows = rows.agg(F.count("*")).scalar()
    of_value = write_through(values.groupBy("sub_feature").agg(
        F.count("*").alias("_nv"), F.sum("value").alias("_sv"),
        F.min("value").alias("_minv"), F.max("value").alias("_maxv"),
    ), "of-value")  # one row a feature, read for the means and for the result
    of_phi = phi.groupBy("sub_feature").agg(
        F.count("*").alias("_np"),
        F.min("phi").alias("_minp"), F.max("phi").alias("_maxp"),
    )
    # Centred before summing: the difference of two large sums would lose its sign near 0.
    means = of_value.select("sub_feature", (F.col("_sv") / n_rows).alias("_mean"))
    co_moment = (
        # One row a feature, and the names are on the driver: without the hint all cells go by feature to few tasks.
        phi.join(F.broadcast(means), "sub_feature", "left")
        .groupBy("sub_feature")
        .agg(F.sum(F.col("phi") * (F.col("value") - F.coalesce("_mean", F.lit(0.0)))).alias("_covariance"))
    )

    def constant(count: str, low: str, high: str):
        """Rows outside the table are zeros and take part in the comparison."""
        padded = F.col("_n") > F.coalesce(count, F.lit(0))
        lo = F.when(padded, F.least(F.lit(0.0), low)).otherwise(F.col(low))
        hi = F.when(padded, F.greatest(F.lit(0.0), high)).otherwise(F.col(high))
        return F.coalesce(lo == hi, F.lit(True))

    return (
        features.select("sub_feature")
        .join(of_value, "sub_feature", "left")
        .join(of_phi, "sub_feature", "left")
        .join(co_moment, "sub_feature", "left")
        .withColumn("_n", n_rows)
        .select(
            "sub_feature",
            F.when(constant("_nv", "_minv", "_maxv"), F.lit(0.0))
            .when(constant("_np", "_minp", "_maxp"), F.lit(None).cast("double"))
            .otherwise(F.signum("_covariance"))
            .alias("direction"),
        )
    )


def gain(nodes: DataFrame, features: DataFrame, n_folds: int) -> DataFrame:
    """Mean gain per split within a fold, 0 where unused, averaged over the folds."""
    per_fold = (
        nodes.filter(F.col("left") >= 0).groupBy("fold", "feature").agg(F.avg("gain").alias("g"))
    )
    total = per_fold.groupBy("feature").agg(F.sum("g").alias("g"))
    return features.join(total, features.idx == total.feature, "left").select(
        "sub_feature", (F.coalesce("g", F.lit(0.0)) / n_folds).alias("gain")
    )


def ranked(table: DataFrame) -> DataFrame:
    """Most important first, equal ones by name; as long as the feature list."""
    return table.orderBy(_rankable(F.col("mean_abs_shap")).desc(), "sub_feature")


def _rank() -> Column:
    """Place by unrounded importance; the window sees one row per feature."""
    return F.row_number().over(Window.orderBy(_rankable(F.col("mean_abs_shap")).desc(), "sub_feature"))


def importance_table(means: DataFrame, gains: DataFrame, directions: DataFrame) -> DataFrame:
    """The pooled ranking: ranked on the exact values, then rounded half-even."""
    joined = means.join(gains, "sub_feature", "left").join(directions, "sub_feature", "left")
    return joined.withColumn("rank", _rank()).orderBy("rank").select(
        "rank",
        "sub_feature",
        F.bround("mean_abs_shap", 3).alias("mean_abs_shap"),
        F.bround("gain", 1).alias("gain"),
        "direction",
    )


def live_ranking(means: DataFrame) -> DataFrame:
    return means.withColumn("rank", _rank()).orderBy("rank").select(
        "rank", "sub_feature", F.bround("mean_abs_shap", 3).alias("mean_abs_shap"))


def by_snapshot(phi: DataFrame, rows: DataFrame, features: DataFrame, n: int) -> DataFrame:
    """The top ``n`` features of every snapshot, newest first, from the pooled attributions."""
    listed = features.agg(F.collect_list("sub_feature")).scalar()
    counts = rows.groupBy("snapshot_t").agg(F.count("*").alias("n_rows"))
    sums = phi.groupBy("snapshot_t", "sub_feature").agg(F.sum(F.abs("phi")).alias("_s"))
    # One row per (snapshot, feature); the window never sees data rows.
    best_first = Window.partitionBy("snapshot_t").orderBy(_rankable(F.col("_m")).desc(), "sub_feature")
    return (
        counts.withColumn("_names", listed)
        .select("snapshot_t", "n_rows", F.explode("_names").alias("sub_feature"))
        .join(sums, ["snapshot_t", "sub_feature"], "left")
        .withColumn("_m", F.coalesce("_s", F.lit(0.0)) / F.col("n_rows"))
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= n)
        .orderBy(F.desc("snapshot_t"), "rank")
        .select("snapshot_t", "n_rows", "rank", "sub_feature", F.bround("_m", 3).alias("mean_abs_shap"))
    )


def latest(per_snapshot: DataFrame) -> DataFrame:
    newest = per_snapshot.agg(F.max("snapshot_t")).scalar()
    return per_snapshot.filter(F.col("snapshot_t") == newest)


def per_row(scored: DataFrame, phi: DataFrame, top: Sequence[str]) -> DataFrame:
    """Label, probability and the attributions to the ``top`` features, one row per (user, snapshot)."""
    labelled = scored.select(*KEYS, "engaged", F.col("score").alias("engaged_probability"))
    carried = labelled.columns
    wide = (
        labelled.join(spread(phi.filter(F.col("sub_feature").isin(*top)).select(*KEYS, "sub_feature", "phi")), KEYS, "left")
        .groupBy(*carried)
        .pivot("sub_feature", list(top))
        .agg(F.sum("phi"))
    )
    return wide.selectExpr(
        *carried, *[f"coalesce({quoted(n)}, 0D) AS {quoted('shap__' + n)}" for n in top]
    )
