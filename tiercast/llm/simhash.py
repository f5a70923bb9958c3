"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that link at ``k`` bits agree on at least one of ``k + 1`` blocks
of bits, so rows meet by (block, value) and no pair is lost. Inside such a group
fingerprints are sorted by Gray rank, where neighbours differ in few bits, and
``FAN`` neighbours at a time are put under a node that holds the bits they
share. A search walks down from the roots, adds up only the differences in bits
that a node fixes beyond its parent, and drops the whole node once they exceed
``k``; what is left at the leaves is the exact distance. A group of more than
``GROUP`` fingerprints is dealt anew by its remaining bits or, where those do
not part it, in pairs of slices, so a frequent block value meets no limit and
costs no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tiercast.sources.storage import write_through

from .common import ship, slices, text_column
from .components import components

WORDS = 4
BITS = 4
SEED = 42
FAN = 8
#: Distinct fingerprints that one index holds; larger (block, value) groups are dealt anew or cut into slices.
GROUP = 4096
#: Rows indexed at once, and pairs of a row and a node examined at once, in a task.
BUFFER, FRONTIER = 65_536, 1_000_000

_FULL = (1 << 64) - 1


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; no word gives 0."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    digest = xxhash.xxh64_intdigest
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[s : s + 8192]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, **carried: Column) -> DataFrame:
    """(doc_id, long columns carried along, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, words, seed) for t in text_column(part, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fps.view(np.int64))], [*part.schema.names[1:], "fp"])

    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        *(c.cast("long").alias(name) for name, c in carried.items()))
    return rows.mapInArrow(hashed, ", ".join(f"{name} long" for name in ["doc_id", *carried, "fp"]))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` blocks of its free bits added, for each block; none if there are fewer bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) < parts:
        return []  # two words may differ in all of them
    return [mask | sum(1 << int(b) for b in block) for block in np.array_split(np.array(free), parts)]


def _gray_rank(fp: Column) -> Column:
    """Place of the word in Gray order: each bit is the parity of all bits from it upwards."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _dealt(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """``rows`` once for each finer mask, as ``finer``: each of ``parts`` blocks of the mask's free bits added."""
    # As many cases as masks in a round: at most (bits + 1) ** round, whatever the data.
    finer = F.array().cast("array<long>")
    for m in masks:
        children = F.array(*(F.lit(_signed(c)) for c in _refine(m, parts))).cast("array<long>")
        finer = F.when(F.col("mask") == F.lit(_signed(m)), children).otherwise(finer)
    return rows.withColumn("finer", F.explode(finer))


def _masks(rows: DataFrame) -> list[int]:
    return [r.mask & _FULL for r in rows.select("mask").distinct().collect()]


def groups(distinct: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(mask, value, first, second, node, fp): rows to compare, together if all but ``fp`` and ``node`` agree.

    Rows meet by the bits of ``mask``. A group above ``group`` rows is dealt
    anew by blocks of its free bits if that at least halves the pairs in it.
    Else it is a dense cluster, which more bits do not part: it is cut into
    slices, and each pair of slices is compared on its own. Either way every
    pair within ``bits`` meets, and nothing larger than two slices is held.
    """
    parts = bits + 1
    whole = [F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second")]
    out: DataFrame | None = None

    def add(rows: DataFrame) -> None:
        nonlocal out
        rows = rows.select("mask", "value", "first", "second", "node", "fp")
        out = rows if out is None else out.unionByName(rows)

    rows, masks = distinct.select(F.lit(0).cast("long").alias("mask"), "node", "fp"), [0]
    while True:
        rows = _dealt(rows, masks, parts).select(
            F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"), "node", "fp")
        key = ["mask", "value"]
        large = write_through(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > group), "large")
        if large.isEmpty():
            add(rows.select("*", *whole))
            return out
        add(rows.join(large, key, "left_anti").select("*", *whole))
        rows = write_through(rows.join(large, key), "crowded")
        finer = _dealt(rows, _masks(rows), parts).groupBy(*key, "n", "finer", F.col("fp").bitwiseAND(F.col("finer")).alias("part")).agg(F.count("*").alias("c"))
        pairs = finer.groupBy(*key, "n").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
        parted = write_through(pairs.where(2 * F.col("pairs") < F.col("n").cast("double") * F.col("n")).select(*key), "parted")
        slices = F.ceil(2 * F.col("n") / group)
        dense = rows.join(parted, key, "left_anti").select(
            *key, "node", "fp", F.pmod(F.xxhash64("fp"), slices).alias("slice"),
            F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("other"))
        add(dense.select("*", F.least("slice", "other").alias("first"), F.greatest("slice", "other").alias("second")))
        if parted.isEmpty():
            return out
        rows = rows.join(parted, key, "left_semi").select("mask", "node", "fp")
        masks = _masks(parted)


class GrayIndex:
    """Node levels over fingerprints sorted by (group, Gray rank).

    Level 0 are the fingerprints. A node of the next level covers up to ``fan``
    neighbours of one group: ``value`` on the bits of ``mask`` is common to all
    of them. ``fresh`` is the part of the mask that the parent lacks.
    """

    def __init__(self, group: np.ndarray, fps: np.ndarray, fan: int = FAN):
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.size = np.diff(np.append(first, n))
        owner = np.repeat(np.arange(len(first)), self.size)
        place = np.arange(n) - first[owner]
        ands, ors, last = fps, fps, np.arange(n)
        self.levels: list[dict] = [{"and": fps, "mask": np.full(n, _FULL, np.uint64), "last": last}]
        while True:
            cut = np.flatnonzero(place % fan == 0)
            counts = np.diff(np.append(cut, len(place)))
            self.levels[-1]["parent"] = np.repeat(np.arange(len(cut)), counts)
            ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
            last, owner, place = last[cut + counts - 1], owner[cut], place[cut] // fan
            self.levels.append({"and": ands, "mask": ~(ands ^ ors), "last": last, "first": cut, "count": counts})
            if not place.any():
                break
        for low, high in zip(self.levels, self.levels[1:]):
            low["fresh"] = low["mask"] & ~high["mask"][low["parent"]]
        self.levels[-1]["fresh"] = self.levels[-1]["mask"]
        self.group_of = np.repeat(np.arange(len(first)), self.size)

    def _kept(self, level: dict, rows: np.ndarray, nodes: np.ndarray, sums: np.ndarray, bits: int):
        off = (self.fps[rows] ^ level["and"][nodes]) & level["fresh"][nodes]
        sums = sums + np.bitwise_count(off)
        keep = (sums <= bits) & (level["last"][nodes] > rows)
        return rows[keep], nodes[keep], sums[keep]

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) with i < j of one group and at most ``bits`` differing bits, in bounded portions."""
        work = np.cumsum(self.size[self.group_of])
        start = 0
        while start < len(self.fps):
            stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER, "right")))
            rows = np.arange(start, min(stop, len(self.fps)))  # roots lie in group order, one each
            nodes, sums = self.group_of[rows], np.zeros(len(rows), np.uint8)
            rows, nodes, sums = self._kept(self.levels[-1], rows, nodes, sums, bits)
            for high, low in zip(self.levels[:0:-1], self.levels[-2::-1]):
                counts = high["count"][nodes]
                ahead = np.repeat(np.cumsum(counts) - counts, counts)
                children = np.repeat(high["first"][nodes], counts) + np.arange(len(ahead)) - ahead
                rows, nodes, sums = self._kept(low, np.repeat(rows, counts), children, np.repeat(sums, counts), bits)
            yield rows, nodes
            start = stop


def spanning(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index each of ``n`` items reaches through the pairs."""
    root = np.arange(n)
    for a, b in portions:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _searched(bits: int):
    def linked(mask, value, first, second, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.zeros(len(fp) - 1, bool)
        for key in (mask, value, first, second):
            change |= key[1:] != key[:-1]
        group = np.concatenate(([0], np.cumsum(change)))
        root = spanning(len(fp), GrayIndex(group, fp.view(np.uint64)).links(bits))
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], schema=_LINK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 6
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
            if len(held[0]) >= BUFFER:
                last = np.logical_and.reduce([h == h[-1] for h in held[:4]])  # may go on in the next batch
                whole = len(last) - int(last.sum())
                if whole:
                    yield linked(*(h[:whole] for h in held))
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield linked(*held)

    return search


def links(distinct: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(a, b): links that join (node, fp) rows exactly as all pairs within ``bits`` do, one a row and group at most."""
    ship(distinct.sparkSession)
    rows = groups(distinct, bits, group).withColumn("rank", _gray_rank(F.col("fp")))
    key = ["mask", "value", "first", "second"]
    laid = rows.repartition(*key).sortWithinPartitions(*key, "rank")
    return laid.select(*key, "node", "fp").mapInArrow(_searched(bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text).

    Equal fingerprints collapse before the search, so copies cost one row. Null
    and empty texts have fingerprint zero and link like any other. Repeated
    rows keep all their rows; rows of one doc_id count as one document. A row
    without an id links too, but never names a component: ids from 2**62 on
    stand in for it, and a component of such rows alone is null. An empty
    table gives no rows; other columns are ignored.
    """
    hashed = write_through(fingerprints(docs, words), "fingerprints")
    unnamed = 1 << 62
    stand_in = F.xxhash64("fp").bitwiseAND(F.lit(unnamed - 1)) + F.lit(unnamed)
    distinct = write_through(hashed.groupBy("fp").agg(F.coalesce(F.min("doc_id"), stand_in).alias("node")), "distinct")
    found = components(links(distinct, bits, group))
    component = F.coalesce("component", "node")
    owner = distinct.join(found, "node", "left").select(
        "fp", F.when(component < unnamed, component).alias("component_id"))
    return hashed.join(owner, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` without near copies: one of each group that fingerprints link, all columns as they are.

    Groups are of texts, whatever their ids: different texts under one doc_id stay, and rows without an id are
    reduced like others. The smallest doc_id stays (a null last), of rows with the same id the
    smallest text hash, then the smallest hash of all columns; so a rerun keeps the same rows, and of wholly equal
    rows one. Null and empty texts form one group with all of fingerprint zero; an empty table gives no rows.
    """
    # Columns of the tables' plain types; a hash of both row and text stands for the row.
    marked = docs.withColumns({"__text": F.xxhash64("text"), "__row": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    hashed = write_through(
        fingerprints(marked, words, text_hash=F.col("__text"), row_hash=F.col("__row")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "row_hash")
    distinct = write_through(hashed.groupBy("fp").agg(F.min(first).alias("first")).withColumn("node", F.col("fp")), "distinct")
    found = components(links(distinct.select("node", "fp"), bits, group))
    kept = (
        distinct.join(found, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__text"), F.col("first.row_hash").alias("__row"))
    )
    same = [marked[c] == kept[c] for c in ("__text", "__row")]
    rows = marked.join(kept, [F.col("doc_id").cast("long").eqNullSafe(kept["__id"]), *same], "left_semi")
    return rows.dropDuplicates(["doc_id", "__text", "__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
