"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its closest reference points (pivots), in order of
closeness. Vectors that are close see the pivots in nearly the same order, so
candidates are those that share at least ``SHARED`` = 2 pivots: the index keeps
an inverted list for each pair of pivots, and a candidate pair is counted once,
in the list of its two smallest shared pivots. Pivots and order are taken about the
mean of the vectors, so that they part vectors of one cone too. How many pivots
describe a vector is measured on pairs planted at the threshold round vectors of
the table, so that recall holds at every size and shape.
Candidates are verified by cosine in double precision.

Lists are compared block against block inside tasks, which return link counts
and spanning links, never pairs. A list longer than ``BLOCK`` rows is cut into
slices, and each pair of slices is a block of its own, so that a crowded list
is spread over tasks and stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tiercast.sources.storage import write_through

from .common import drawn, ship
from .components import components
from .simhash import spanning

THRESHOLD = 0.95
NEAREST, MOST = 5, 16
SHARED = 2
BLOCK = 2048
_PIVOT_BITS = 20


@dataclass(frozen=True)
class Pivots:
    """Number of pivots: a power of two near sqrt(vectors), at least ``least``, so lists keep their length.

    They come from about ``sample`` times as many vectors, drawn and ordered by
    hash: one is taken if its cosine with all taken before is below ``apart``, so that a
    crowd of near copies gives one pivot. Fixed random directions fill up. Pivots and sample take up to
    ``held`` bytes each. A vector is described by as few pivots, ``NEAREST`` or more, as let a share of ``recall`` of
    ``planted`` pairs share two; where ``MOST`` do not, there are half as many pivots, and lists are longer.
    """

    least: int = 256
    sample: int = 8
    apart: float = 0.7
    recall: float = 0.975
    planted: int = 1024
    held: int = 128 << 20

    def number(self, vectors: int, size: int = 1) -> int:
        number = min(max(self.least, 1 << int(np.ceil(np.log2(max(vectors, 1)) / 2))), 1 << _PIVOT_BITS)
        while number > 2 * MOST and number * size * 8 > self.held:
            number //= 2
        return number

    def drawn(self, number: int, size: int) -> int:
        """Vectors in the sample."""
        return min(self.sample * number, self.held // (size * 8))


@dataclass(frozen=True)
class Index:
    """The fitted index of vectors of one length."""

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int

    def order(self, units: np.ndarray, most: int | None = None) -> np.ndarray:
        """The closest pivots of unit vectors, nearest first."""
        close = (units - self.mean) @ self.pivots.T
        return np.argsort(-close, axis=1, kind="stable")[:, : most or self.nearest]


def usable(vector: Column) -> Column:
    """True for vectors that have a direction: no null or non-finite component and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return _scaled(rows)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def choose(sample: np.ndarray, number: int, apart: float) -> np.ndarray:
    """``number`` unit pivots: far-apart rows of the sample in its order, then fixed random directions."""
    size = sample.shape[1]
    taken = np.empty((0, size))
    for start in range(0, len(sample), 256):
        part = _scaled(sample[start : start + 256])
        part = part[(part @ taken.T).max(axis=1, initial=-1) < apart]
        close = part @ part.T
        fresh: list[int] = []
        for i in range(len(part)):
            if not fresh or close[i, fresh].max() < apart:
                fresh.append(i)
        taken = np.concatenate((taken, part[fresh]))[:number]
        if len(taken) == number:
            break
    fill = np.random.default_rng(0).standard_normal((number - len(taken), size))
    return np.concatenate((taken, fill / np.linalg.norm(fill, axis=1, keepdims=True)))


def fit(sample: np.ndarray, number: int, size: int, how: Pivots, threshold: float = THRESHOLD) -> Index:
    """The index for a sample of vectors (which may be empty), with as many of ``number`` pivots as recall allows."""
    random = np.random.default_rng(1)
    units = _units(sample) if len(sample) else np.empty((0, size))
    mean = units.mean(axis=0) if len(units) else np.zeros(size)
    probes = units[: how.planted] if len(units) else _scaled(random.standard_normal((how.planted, size)))
    probes = np.tile(probes, (-(-how.planted // len(probes)), 1))[: how.planted]
    aside = random.standard_normal(probes.shape)
    aside = _scaled(aside - (aside * probes).sum(axis=1, keepdims=True) * probes)
    copies = _scaled(threshold * probes + np.sqrt(max(0.0, 1 - threshold**2)) * aside)
    while True:
        index = Index(mean, choose(units - mean, number, how.apart), 0)
        shared = np.zeros(MOST + 1)
        for s in range(0, len(probes), 256):
            first, second = (index.order(x[s : s + 256], MOST) for x in (probes, copies))
            # The place by which a pivot is among the closest of both; the second smallest completes a pair.
            both = np.where(first[:, :, None] == second[:, None, :], np.maximum.outer(np.arange(MOST), np.arange(MOST)), MOST)
            from_place = np.sort(both.reshape(len(both), -1), axis=1)[:, SHARED - 1]
            shared += np.bincount(from_place, minlength=MOST + 1)
        reached = np.cumsum(shared)[:MOST] / len(probes) >= how.recall
        if reached.any() or number <= 2 * MOST:
            enough = int(np.argmax(reached)) + 1 if reached.any() else MOST
            return Index(mean, index.pivots, max(NEAREST, enough))
        number //= 2


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def describe(reps: DataFrame, how: Pivots = Pivots(), threshold: float = THRESHOLD) -> DataFrame:
    """``reps`` (node, vector, weight) with ``pivots``: the indices of the closest pivots, nearest first.

    Vectors are compared with vectors of their own length only; each length has pivots of its own.
    """
    spark = reps.sparkSession
    ship(spark)
    sizes = {r["size"]: r["n"] for r in reps.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    fitted = {}
    for size, n in sizes.items():
        number = how.number(n, size)
        of = reps.where(F.size("vector") == size)
        rows = of.where(drawn(how.drawn(number, size) / n, "vector")).select(F.xxhash64("vector").alias("hash"), "vector").toArrow()
        order = np.argsort(rows["hash"].to_numpy(), kind="stable")
        sample = _vectors(rows["vector"].combine_chunks(), size)[order] if len(order) else np.empty((0, size))
        fitted[size] = fit(sample, number, size, how, threshold)
    shared = spark.sparkContext.broadcast(fitted)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
                near = [None] * batch.num_rows
                for size in np.unique(lengths):
                    at = np.flatnonzero(lengths == size)
                    order = shared.value[size].order(_units(_vectors(batch.column("vector").take(pa.array(at)), size)))
                    for i, row in zip(at, order.tolist()):
                        near[i] = row
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "pivots"])

    return reps.mapInArrow(described, reps.withColumn("pivots", F.array().cast("array<int>")).schema)


def _lists(pivots: Column) -> Column:
    """The inverted lists of a vector: one key for each pair of its pivots, smaller pivot first."""
    p = F.sort_array(pivots)
    return F.flatten(F.transform(p, lambda a, at: F.transform(
        F.slice(p, at + 2, F.size(p)), lambda b: F.shiftleft(a.cast("long"), _PIVOT_BITS) + b)))


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compared(threshold: float):
    def block(key: int, first: int, second: int, size: int, node, weight, vector, pivots, slice_no):
        p, q = key >> _PIVOT_BITS, key & ((1 << _PIVOT_BITS) - 1)
        units = _units(vector)
        left = np.flatnonzero(slice_no == first)
        right = left if first == second else np.flatnonzero(slice_no == second)
        links = np.zeros(len(node), np.int64)
        lower = np.where((pivots < q) & (pivots != p), pivots, -1)
        found = []
        for s in range(0, len(left), 512):
            i, j = np.nonzero(units[left[s : s + 512]] @ units[right].T >= threshold)
            i, j = left[s : s + 512][i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            # Counted elsewhere if a smaller pivot is shared: then this is not their smallest pair.
            own = np.ones(len(i), bool)
            for a in range(lower.shape[1]):
                for b in range(lower.shape[1]):
                    own &= (lower[i, a] != lower[j, b]) | (lower[i, a] < 0)
            i, j = i[own], j[own]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            found.append((i, j))
        root = spanning(len(node), iter(found))
        at = np.flatnonzero(links)
        return node[at], node[root[at]], links[at]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(whole: bool) -> Iterator[pa.RecordBatch]:
            """Results of the blocks that are complete; the last one may go on in the next batch."""
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            if not table:
                return
            batch = table[0]
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "list", "first", "second")])
            cuts = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            out = []
            for start, stop in zip(cuts[: -1 if whole else -2], cuts[1:]):
                part = batch.slice(start, stop - start)
                size, key, first, second = ids[:, start].tolist()
                plain = [part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight")]
                pivots = part.column("pivots")
                out.append(block(key, first, second, size, *plain, _vectors(part.column("vector"), size),
                                 _vectors(pivots, len(pivots[0])), part.column("slice").to_numpy(zero_copy_only=False)))
            held[:] = [] if whole else [batch.slice(cuts[-2])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_LINKED)

        rows = 0
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(s, BLOCK))
                rows += held[-1].num_rows
                if rows >= 4 * BLOCK:
                    yield from settled(False)
                    rows = held[0].num_rows
        if held:
            yield from settled(True)

    return compare


def link_rows(described: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, n): for a node and block of a list, a node it is joined to and the rows linked there (by weight)."""
    ship(described.sparkSession)
    posted = described.select("node", F.size("vector").alias("size"), F.explode(_lists(F.col("pivots"))).alias("list"))
    lengths = posted.groupBy("size", "list").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    slices = F.ceil(F.col("n") / block)
    rows = posted.join(lengths, ["size", "list"]).select(
        "node", "size", "list", F.pmod(F.xxhash64("node"), slices).alias("slice"),
        F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("other"))
    rows = rows.select(
        "node", "size", "list", "slice", F.least("slice", "other").alias("first"), F.greatest("slice", "other").alias("second"))
    laid = rows.join(described, "node").repartition("size", "list", "first", "second").sortWithinPartitions(
        "size", "list", "first", "second")
    return laid.select("size", "list", "first", "second", "slice", "node", "weight", "vector", "pivots").mapInArrow(
        _compared(threshold), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, how: Pivots = Pivots()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Equal vectors collapse into one before the search and count with all their
    rows afterwards. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing: each is its own component. Vectors
    of different lengths do not link. Repeated vec_ids keep all their rows, each
    judged by its vector. A row without an id never names a component, and is
    kept only where no row of its component has one. An empty table gives no
    rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector")))
    good = rows.where("usable")
    reps = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    reps = write_through(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    described = write_through(describe(reps.select("node", "vector", "weight"), how, threshold), "described")
    found = write_through(link_rows(described, threshold), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    named = components(found.select("a", "b"))
    labelled = reps.join(counts, "node", "left").join(named, "node", "left").select(
        "vector", "least", F.coalesce("component", "node").alias("group"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    ids = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    owner = labelled.join(ids, "group").select("vector", "n_links", "component_id")
    linked = good.select("vec_id", "vector").join(owner, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
