"""Reading and shaping the input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Columns taken from the daily tier table, in its own order.
PERSONA_COLUMNS = (
    "user_id", "acct_id", "time_period", "pre_activity", "tenure_days",
    "last_active", "days_since_active", "user_category", "reason",
    "user_category_score", "user_category_percentile_compared_to_peers",
    "usage_persona", "usage_depth", "usage_depth_pct",
    "login_frequency_persona", "active_days_ratio", "active_days_ratio_pct",
    "feature_persona", "breadth_ratio", "breadth_ratio_pct",
)

# Source name -> name used from here on.
PERSONA_RENAMES = {
    "time_period": "score_date",
    "tenure_days": "day_of_journey",
    "last_active": "last_session_login_date",
    "days_since_active": "days_inactive",
    "user_category": "user_category_persona",
    "reason": "user_category_reason",
    "user_category_percentile_compared_to_peers": "user_category_percentile_compared_today",
    "usage_persona": "usage_depth_persona",
    "usage_depth_pct": "usage_depth_percentile_compared_today",
    "active_days_ratio": "login_ratio",
    "active_days_ratio_pct": "login_frequency_percentile_compared_today",
    "breadth_ratio": "feature_adoption_ratio",
    "breadth_ratio_pct": "feature_adoption_percentile_compared_today",
    "feature_persona": "feature_adoption_persona",
}


def scan(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet folder (anything with a slash) or a catalog table, pruned to ``columns``."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(*columns) if columns else df


def ingest_personas(
    raw: DataFrame,
    columns: Sequence[str] = PERSONA_COLUMNS,
    rename: Mapping[str, str] = PERSONA_RENAMES,
    const_false: Sequence[str] = ("is_test_a", "is_test_b"),
) -> DataFrame:
    """Project, rename, and add the test flags the source does not carry."""
    return (
        raw.select(*columns)
        .withColumnsRenamed(dict(rename))
        .withColumns({name: F.lit(False) for name in const_false})
    )
