"""Embedding whitening: projections on the leading principal components, scaled to unit variance.

Entries become whole numbers x = floor(1024 c) + 100000, so that counts, sums
and distances from the mean are exact. Three scans read the vectors: sums, the
scatter of the centred vectors, projections. A task gives one small matrix,
whatever its rows; the matrices are added up row by row of the matrix. The
eigenpairs of the covariance, as large as one vector's length squared, come
from spectrum slicing (``spectrum``) on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tiercast.sources.storage import write_through

from .common import ship
from .spectrum import leading
from .tokens import bounds

COMPONENTS = 8
#: Rows worked on at once; with the limit below, sums over so many stay within 64 bits.
_ROWS = 1024
#: Larger whole numbers, from entries beyond 4 * 10**12, count as this.
LIMIT = 1 << 52

_SUMS = pa.schema([("size", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])
_SCATTER = pa.schema([("at", pa.int32()), ("row", pa.list_(pa.float64()))])
_SCORES = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
_MOMENTS = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Whitener:
    """What a fit found: vectors counted, sums by dimension, leading eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vector: the usable rows and their entries as whole numbers, a row each."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry reads as NaN
    begins = bounds(np.maximum(lengths, 0))
    bad = bounds(~np.isfinite(flat))
    usable = (lengths >= 0) & (bad[begins[1:]] == bad[begins[:-1]])
    for size in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == size))
        c = flat[(begins[rows, None] + np.arange(size)).ravel()].reshape(len(rows), size)
        with np.errstate(over="ignore"):  # the largest doubles times 1024
            x = np.clip(np.floor(c * 1024.0) + 100_000.0, -LIMIT, LIMIT)
        yield rows, x.astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit whole numbers where they are enough, else Python's."""
    s = np.array(sums, dtype=object)
    if n * LIMIT < 1 << 62 or n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def _square_sums(off: np.ndarray) -> list[int]:
    """The sum of the squares of each row, exact; halves of 26 bits keep 64-bit sums exact below 2**52."""
    if off.dtype == object or off.shape[1] > 1 << 10 or np.abs(off).max(initial=0) >= 1 << 52:
        return [sum(int(v) ** 2 for v in row) for row in off]
    high, low = off >> 26, off & ((1 << 26) - 1)
    terms = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*(t.tolist() for t in terms))]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [
            (size, at, n, Decimal(int(total)))
            for size, (n, totals) in held.items() for at, total in enumerate(totals if size else [0])]
        held.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)

    for part in _parts(batches):
        for rows, x in whole_numbers(part.column("vector")):
            n, totals = held.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
            held[x.shape[1]] = n + len(rows), totals + x.sum(axis=0).astype(object)
        if len(held) > 64:  # vectors of many lengths
            yield from flush()
    yield from flush()


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows with the same place in the matrix."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        places = batch.column("at").to_pylist()
        rows = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1)
        for at, row in zip(places, rows):
            held[at] = held[at] + row if at in held else row.copy()
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], schema=_SCATTER)


def _vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    return embeddings.select(F.col(vector).alias("vector"))


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """Mean and leading eigenpairs of the covariance (divisor n, centred first) of all usable vectors.

    Null vectors and vectors with null or non-finite entries count for nothing.
    Vectors of different lengths share no covariance: those of the commonest
    length are used (the longer on a tie). Eigenvalues that are 0 but for rounding give no
    component; a table without usable vectors gives n = 0 and none.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = _vectors(embeddings, vector)
    counted = vectors.mapInArrow(_sums, "size int, at int, n long, total decimal(38,0)")
    counted = write_through(counted.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    commonest = counted.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if commonest is None or commonest["size"] == 0:
        return Whitener(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    n, size = commonest["n"], commonest["size"]
    sums = [int(r.total) for r in counted.where(F.col("size") == size).orderBy("at").collect()]  # one row a dimension

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for part in _parts(batches):
            for _, x in whole_numbers(part.column("vector")):
                if x.shape[1] == size:
                    centred = (_off_mean(x, n, sums) / n).astype(np.float64)
                    total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=_SCATTER)

    rows = vectors.mapInArrow(scatter, "at int, row array<double>").repartition("at").mapInArrow(_add_rows, "at int, row array<double>")
    covariance = np.array([r.row for r in sorted(rows.collect(), key=lambda r: r.at)]) / n  # a row for each dimension
    values, basis = leading(covariance, components)
    return Whitener(n, sums, values, basis, float(np.trace(covariance)))


def project(embeddings: DataFrame, fitted: Whitener, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, deviation decimal, whitened array) of every usable vector of the fitted length.

    ``deviation`` is the sum over dimensions of (n x - S)², exact; ``whitened``
    holds x - S/n projected on each component, over the root of its eigenvalue.
    Null and repeated ids and repeated vectors keep all their rows; other columns are ignored.
    """
    ship(embeddings.sparkSession)
    size, scaled = len(fitted.sums), fitted.vectors / np.sqrt(fitted.values) if len(fitted.values) else None
    n, sums, count = fitted.n, fitted.sums, len(fitted.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            for rows, x in whole_numbers(part.column("vector")):
                if x.shape[1] != size or not n:
                    continue
                off = _off_mean(x, n, sums)
                scores = (off / n).astype(np.float64) @ scaled if count else np.empty((len(rows), 0))
                ends = pa.array(np.arange(len(rows) + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(rows)), pa.array(map(Decimal, _square_sums(off)), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(ends, pa.array(scores.ravel())),
                ], schema=_SCORES)

    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(
        projected, "vec_id long, deviation decimal(38,0), whitened array<double>")


def _together(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Count, mean and scatter about the mean of the union of parts, each centred on its own mean."""
    n, mean, scatter = 0, None, None
    for m, other, spread in parts:
        if not n:
            n, mean, scatter = m, other, spread
            continue
        step = other - mean
        scatter = scatter + spread + np.outer(step, step) * (n * m / (n + m))
        n, mean = n + m, mean + step * (m / (n + m))
    return (n, mean, scatter) if n else None


def _moments(found) -> Iterator[pa.RecordBatch]:
    if found is not None:
        n, mean, scatter = found
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((n, mean.tolist(), scatter.ravel().tolist()), _MOMENTS)], schema=_MOMENTS)


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured over all rows."""
    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if batch.num_rows:
                    w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                    mean = w.mean(axis=0)
                    yield len(w), mean, (w - mean).T @ (w - mean)
        yield from _moments(_together(parts()))

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        yield from _moments(_together(
            (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(components, -1)) for r in rows))

    schema = "n long, mean array<double>, scatter array<double>"
    # One row of components squared a task, taken in one at a time.
    whole = projected.select("whitened").mapInArrow(of_rows, schema).repartition(1).mapInArrow(of_parts, schema).first()
    covariance = np.array(whole.scatter).reshape(components, -1) / whole.n
    return float(np.abs(covariance - np.eye(components)).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the fit on all usable vectors, applied to them.

    Columns vec_id, component (from 1, by falling eigenvalue), n, deviation
    (long; null beyond 64 bits), whitened, explained (share of the trace),
    identity_error (the same on all rows). See ``fit`` and ``project`` for nulls,
    repeats and lengths. Fewer dimensions, or eigenvalues of 0, give fewer
    components; without any there are no rows.
    """
    fitted = fit(embeddings, vector, components)
    # Read twice: to measure the covariance, and for the result.
    rows = write_through(project(embeddings, fitted, vector, vec_id), "whitened")
    count = len(fitted.values)
    error = identity_error(rows, count) if fitted.n and count else 0.0
    shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as long)").alias("deviation"), "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
