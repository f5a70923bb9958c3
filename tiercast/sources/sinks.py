"""Writers for the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def add_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the folders that ``df`` has rows for; the other folders are not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def by_snapshot(usage_long: DataFrame) -> DataFrame:
    """Windowed usage laid out for one folder per snapshot.

    Ranges of (snapshot, user) go to the writing tasks: a task meets one or two
    snapshots and so opens few files, and a large snapshot has many writers.
    """
    return usage_long.repartitionByRange("snapshot_t", "user_id")


def add_usage(usage_long: DataFrame, path: str) -> None:
    """Windowed usage of further snapshots, a folder each."""
    add_parquet(by_snapshot(usage_long), path, "snapshot_t")


def write_by_day(rows: DataFrame, path: str, day: str, folder: str, add: bool = False) -> None:
    """Rows of users, one folder per ``day`` under the name ``folder``; with ``add``, the folders of other days stay.

    The folder has a column of its own: were it ``day``, a join on that key would
    run its other side twice to prune folders that are all wanted. It is a date, which sorts faster than text.
    """
    laid_out = rows.repartitionByRange(day, "user_id").withColumn(folder, F.col(day))
    (add_parquet if add else write_parquet)(laid_out, path, folder)


def write_segments(segments: DataFrame, path: str, add: bool = False) -> None:
    """Segments, one folder per day; with ``add``, the folders of other days stay."""
    write_by_day(segments, path, "snapshot_t", "segment_day", add)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("segment_day")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header and ISO dates; ``single_file`` is for short rankings only."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, DateType)]
    out = df.withColumns({d: F.date_format(d, "yyyy-MM-dd") for d in dates}) if dates else df
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
