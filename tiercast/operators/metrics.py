"""Exact ranking metrics and class statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tiercast.operators.ranks import bucket_by_quantile


def score_curve(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "engaged"
) -> DataFrame:
    """Per distinct score, best first: its positives and negatives and those ranked above.

    Equal scores collapse before anything is ordered; the running sums are
    built per score bucket and lifted by the totals of the better buckets.
    """
    y = F.col(label).cast("bigint")
    points = (
        bucket_by_quantile(scored.select(*by, score, y.alias("_y")), score, "_bucket")
        .groupBy(*by, "_bucket", score)
        .agg(F.sum("_y").alias("n_pos"), F.sum(1 - F.col("_y")).alias("n_neg"))
    )
    better = (
        Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most 1,024 rows per group.
    totals = points.groupBy(*by, "_bucket").agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    lifts = totals.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_p").over(better), F.lit(0)).alias("_pos_above"),
        F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_neg_above"),
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(F.desc(score))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        points.withColumn("_cp", F.sum("n_pos").over(inside))
        .withColumn("_cn", F.sum("n_neg").over(inside))
        .join(lifts, [*by, "_bucket"])
        .select(
            *by, score, "n_pos", "n_neg",
            (F.col("_pos_above") + F.col("_cp") - F.col("n_pos")).alias("pos_above"),
            (F.col("_neg_above") + F.col("_cn") - F.col("n_neg")).alias("neg_above"),
        )
    )


def ranking_metrics(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "engaged"
) -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision, in one pass.

    Null where a group lacks one of the classes.
    """
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    through_pos = F.col("pos_above") + n_pos
    through_all = through_pos + F.col("neg_above") + n_neg
    sums = score_curve(scored, by, score, label).groupBy(*by).agg(
        F.sum(n_pos).alias("p"),
        F.sum(n_neg).alias("n"),
        F.sum(n_neg * (F.col("pos_above") + n_pos / 2)).alias("wins"),
        F.sum(n_pos * through_pos / through_all).alias("precision_sum"),
    )
    return sums.select(
        *by,
        (F.col("p") + F.col("n")).alias("n_rows"),
        F.when(F.col("n") > 0, F.try_divide("wins", F.col("p") * F.col("n"))).alias("roc_auc"),
        F.try_divide("precision_sum", "p").alias("average_precision"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = (), **columns: str) -> DataFrame:
    return ranking_metrics(scored, by, **columns).select(*by, "roc_auc")


def average_precision(scored: DataFrame, by: Sequence[str] = (), **columns: str) -> DataFrame:
    return ranking_metrics(scored, by, **columns).select(*by, "average_precision")


def base_rate(rows: DataFrame, label: str = "engaged") -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        F.avg(label).alias("base_rate"),
    )


def class_weight(rows: DataFrame, label: str = "engaged") -> DataFrame:
    """Weight of a positive row: negatives per positive."""
    y = F.col(label).cast("bigint")
    counts = rows.agg(F.sum(y).alias("n_pos"), F.sum(1 - y).alias("n_neg"))
    return counts.withColumn("pos_weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))
