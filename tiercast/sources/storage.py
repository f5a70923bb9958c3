"""Tables written to the cluster's shared folder.

Reused frames are written there and read back: lineage ends at files that
outlive a lost executor, and the next plan starts from Parquet statistics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

_written: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, where driver and
    executors share one machine; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if sc.getCheckpointDir() is not None:
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tiercast-")
        sc.setCheckpointDir(root)
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tiercast-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a fresh folder and return the table read back from it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *tasks: Callable) -> list:
    """The results of independent Spark work, run at the same time: one fills the cores that the last tasks of another leave."""
    with ThreadPool(len(tasks)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a side of a join that grows with the users or their events: joined by key, never broadcast.

    Spark measures a staged table by its files. Long runs of equal days, tiers and accounts take next
    to no room there, so that a table of 10 million rows can pass for a small one, be collected on
    the driver and sent whole to every executor.
    """
    return df.hint("merge")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Constant-size digest of the files below ``paths``; reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    row = files.agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("digest"),
    ).first()
    return f"{row.n}-{row.bytes}-{row.digest & 0xFFFFFFFFFFFFFFFF:x}"


def stage(spark: SparkSession, name: str, version: str, build) -> DataFrame:
    """The table ``name`` of ``version``: built and written once per application."""
    key = f"{spark.sparkContext.applicationId}/{name}/{version}"
    if key not in _written:
        path = fresh_path(spark, name)
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
