"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, which bounds what a Python worker unpacks at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers if they cannot import it; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return

    def importable(_):
        try:
            import tiercast.llm  # noqa: F401
        except ImportError:
            return [False]
        return [True]

    if not all(sc.parallelize(range(2), 2).mapPartitions(importable).collect()):
        package = Path(__file__).parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tiercast-")) / f"tiercast-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns of these names out of the way, for an operator that adds columns of the names."""
    taken = {n.lower() for n in names}
    return df.withColumnsRenamed({c: f"__own_{c}" for c in df.columns if c.lower() in taken})


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in ``df``, those set aside under their own names again."""
    return df.select(*(F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in df.columns else F.col(f"`{c}`") for c in like.columns))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store behind ``path`` and the path inside it; usable on driver and executors alike."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def drawn(share, *columns: str):
    """True for about ``share`` of the distinct values of ``columns``, the same ones in every run."""
    place = F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(1 << 30))
    return place < F.lit(1 << 30) * share


def learnable(doc_id: str, folds: int, held: int):
    """True for rows a model may learn from: crc32 of the id as text, modulo ``folds``, is not ``held``."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) != held, F.lit(False))


def held_out(doc_id: str, folds: int, held: int):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
