"""Feature lists and the (user, snapshot) x feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import quoted, sanitize_name, sanitize_text
from tiercast.functions.vectors import sparse
from tiercast.operators.population import KEYS
from tiercast.sources.storage import spread


def at_risk_usage(usage_long: DataFrame, at_risk: DataFrame) -> DataFrame:
    """Windowed usage of the at-risk (user, snapshot) keys."""
    return usage_long.join(spread(at_risk.select(*KEYS)), KEYS, "left_semi")


def feature_list(usage: DataFrame) -> DataFrame:
    """Sanitised sub-feature names in name order, numbered from 0.

    The distinct names are as many as the feature dictionary, not the data has.
    """
    raw = usage.select("sub_feature").distinct()  # cleaned once a name, not once a row
    return _numbered(raw.select(sanitize_name(F.col("sub_feature")).alias("sub_feature")).distinct())


def _numbered(names: DataFrame) -> DataFrame:
    """Names in order, numbered from 0; the window sees one row per name."""
    place = F.row_number().over(Window.orderBy("sub_feature")) - 1
    return names.filter(F.col("sub_feature").isNotNull()).select(place.alias("idx"), "sub_feature")


def model_features(features: DataFrame, cfg: PanelConfig) -> DataFrame:
    """The list without the features excluded from the model, numbered anew."""
    excluded = [sanitize_text(f) for f in cfg.exclude_features]
    kept = features.filter(~F.col("sub_feature").isin(*excluded)) if excluded else features
    return _numbered(kept)


def feature_names(features: DataFrame) -> list[str]:
    """The ordered names on the driver: the feature dictionary, which a model file carries too."""
    return [r.sub_feature for r in features.select("idx", "sub_feature").orderBy("idx").collect()]


def feature_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "idx int, sub_feature string")


def _with_usage(at_risk: DataFrame, usage_long: DataFrame) -> DataFrame:
    """At-risk rows with their usage; rows without any keep one line with a null feature."""
    named = usage_long.select(*KEYS, sanitize_name(F.col("sub_feature")).alias("sub_feature"), "early_events")
    return at_risk.join(spread(named), KEYS, "left")


def feature_matrix(at_risk: DataFrame, usage_long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per name of ``names``, in that order: events, 0 where there are none.

    Further columns of ``at_risk``, such as the label, ride along as grouping
    columns. One join keeps the rows without usage and feeds the pivot, whose
    grouping reuses the join's partitioning. Names absent from the data become
    zero columns; names outside the list are ignored.
    """
    carried = at_risk.columns
    wide = (
        _with_usage(at_risk, usage_long)
        .groupBy(*carried)
        .pivot("sub_feature", list(names))
        .agg(F.sum("early_events"))
    )
    return wide.selectExpr(
        *map(quoted, carried), *[f"coalesce({quoted(n)}, 0L) AS {quoted(n)}" for n in names]
    )


def sparse_matrix(at_risk: DataFrame, usage_long: DataFrame, features: DataFrame) -> DataFrame:
    """The matrix for long feature lists: parallel arrays of feature index and events.

    Events are summed per feature first, so a row's arrays are never longer
    than the feature list.
    """
    carried = at_risk.columns
    # No hint: the list is small only as long as the feature dictionary is.
    known = _with_usage(at_risk, usage_long).join(features, "sub_feature", "left")
    cells = known.groupBy(*carried, "idx").agg(F.sum("early_events").alias("n"))
    packed = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "n"))))
    return (
        cells.groupBy(*carried)
        .agg(packed.alias("cells"))
        .select(*carried, F.col("cells.idx").alias("indices"), F.col("cells.n").alias("values"))
    )


def sparse_rows(at_risk: DataFrame, usage_long: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """``at_risk`` with ``x``: the logged events of the features used, as a sparse vector of ``size``.

    A row is as long as its own usage, however long the feature list is; no
    column per feature, so nothing limits the list.
    """
    cells = sparse_matrix(at_risk, usage_long, features)
    used = F.filter(F.arrays_zip("indices", "values"), lambda c: c["values"] != 0)
    return cells.withColumn("_used", used).select(
        *at_risk.columns,
        sparse(F.col("_used.indices"), F.transform("_used.values", lambda n: F.log1p(n.cast("double"))), size).alias("x"),
    )


def training_set(frame: DataFrame, usage_long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Label and features of every at-risk row of the panel."""
    at_risk = frame.filter("at_risk").select(*KEYS, "engaged")
    return feature_matrix(at_risk, usage_long, names)


def log_features(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Event counts on the log1p scale; the other columns stay."""
    wanted = set(names)
    return matrix.selectExpr(
        *[f"log1p({quoted(c)}) AS {quoted(c)}" if c in wanted else quoted(c) for c in matrix.columns]
    )


def logged_array(names: Sequence[str]) -> Column:
    """The named count columns as one array of log1p values."""
    return F.expr("array(" + ", ".join(f"log1p({quoted(n)})" for n in names) + ")")


def align_features(present: DataFrame, trained: DataFrame) -> DataFrame:
    """The trained list in its own order, marking the names this data does not have."""
    seen = present.select("sub_feature").distinct().withColumn("is_present", F.lit(True))
    return trained.join(seen, "sub_feature", "left").select(
        "idx", "sub_feature", F.coalesce("is_present", F.lit(False)).alias("is_present")
    )


def unseen_features(present: DataFrame, trained: DataFrame) -> DataFrame:
    """Names in this data that the model never saw; scoring leaves them out."""
    return present.select("sub_feature").distinct().join(trained, "sub_feature", "left_anti")
