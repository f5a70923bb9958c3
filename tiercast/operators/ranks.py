"""Exact ranks and running sums without one global sort.

Rows are cut into value buckets. Bucket totals are few, so their running sums
are cheap; inside a bucket a window finishes the work. Each task sorts one
bucket, and the result equals that of a single ordered window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from tiercast.sources.storage import spread

# Buckets over a uniform 32-bit hash: its upper 12 bits.
HASH_BUCKETS = 4096
_HASH_STEP = 2**32 // HASH_BUCKETS


def rank_by_hash(
    df: DataFrame, hash_col: str, ties: Sequence[str], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: the 1-based rank by (hash, ties), optionally within groups.

    The hash is uniform, so a group of any size falls into even buckets.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(hash_col) / _HASH_STEP).cast("int"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most HASH_BUCKETS rows per group, but more with every user until then. The rows already lie by these keys.
    offsets = (
        bucketed.groupBy(*within, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*within, "_bucket").orderBy(hash_col, *ties)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(spread(offsets), [*within, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_bucket", "_before", "_rn")
    )


# Cut points for score buckets.
_CUTS = 1023


def bucket_by_quantile(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the bucket of ``column`` between approximate quantiles of its values.

    The cut points come from the data, so a narrow band of scores is cut as
    finely as a wide one. They need not be exact: any cuts give exact sums.
    At most ``_CUTS`` numbers reach the driver.
    """
    at = [(i + 1) / (_CUTS + 1) for i in range(_CUTS)]
    cuts = df.agg(F.percentile_approx(column, at, 10_000)).first()[0]
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *sorted(set(map(float, cuts))), float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)
