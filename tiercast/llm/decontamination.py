"""Benchmark passages in documents: Wu-Manber search over words.

The patterns are the windows of ``WINDOW`` consecutive words of every benchmark
item (a shorter item is one window). Patterns of one length share tables: a
block of two words maps to the shift that cannot skip an occurrence; a block
that ends a pattern maps to a bucket, split by the first words, whose windows
are compared word by word. Most text is passed in steps of up to ``WINDOW - 1``
words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tiercast.sources.storage import fresh_path, write_through

from .common import filesystem, restored, set_aside, ship, slices, text_column

WINDOW = 13
BLOCK = 2
#: A document is contaminated if hit words are this share of its words or more (1 / SHARE).
SHARE = 20
#: Benchmark windows searched for in one pass, about; a larger benchmark takes more passes over the documents.
PASS_WORDS = 500_000
#: A piece of an item holds at most this part of a pass.
PIECES = 128

# A-Z lower-cased; digits, letters and all bytes of characters beyond ASCII stay; the rest parts words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class WuManber:
    """Search tables over the windows of (item, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple, set] = defaultdict(set)
        for item, w in items:
            for i in range(max(1, len(w) - window + 1)):
                if w:
                    owners[tuple(w[i : i + window])].add(item)
        self.tables = []
        for size in sorted({len(p) for p in owners}):
            block = min(BLOCK, size)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
            for p, found in owners.items():
                if len(p) == size:
                    for j in range(block, size + 1):
                        key = p[j - block : j]
                        shift[key] = min(shift.get(key, size), size - j)
                    buckets[p[size - block :]][p[:block]].append((list(p), sorted(found)))
            self.tables.append((size, block, shift, {k: dict(v) for k, v in buckets.items()}))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of every occurrence of a window, and the items they belong to."""
        spans, items = [], set()
        n = len(w)
        for size, block, shift, buckets in self.tables:
            skip, i = size - block + 1, size
            while i <= n:
                key = (w[i - 2], w[i - 1]) if block == 2 else tuple(w[i - block : i])
                step = shift.get(key, skip)
                if step:
                    i += step
                    continue
                for pattern, found in buckets[key].get(tuple(w[i - size : i - size + block]), ()):
                    if w[i - size : i] == pattern:
                        spans.append((i - size, i))
                        items.update(found)
                i += 1
        return spans, items


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def portions(benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> list[str]:
    """Folders in the shared folder that hold the benchmark, each about ``pass_words`` windows of it.

    Items are cut into pieces with all their windows, so that a long item spreads
    over portions; a hash deals the distinct pieces. No item reaches the driver.
    """
    spark = benchmark.sparkSession
    ship(spark)
    most = max(1, pass_words // PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, parts, counts = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), text_column(batch, "text")):
                w = words(text)
                n = max(1, len(w) - window + 1) if w else 0
                for a in range(0, n, most):
                    b = min(a + most, n)
                    ids.append(item)
                    parts.append(b" ".join(w[a : b + window - 1]))
                    counts.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(parts, pa.binary()), pa.array(counts, pa.int64())],
                names=["item", "words", "n"])

    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    pieces = write_through(items.mapInArrow(cut, "item string, words binary, n long").distinct(), "benchmark-pieces")
    count = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // pass_words)
    if not count:
        return []
    path = fresh_path(spark, "benchmark")
    dealt = pieces.select("item", "words", F.pmod(F.xxhash64("item", "words"), F.lit(count)).alias("portion"))
    dealt.repartition("portion").write.partitionBy("portion").parquet(path)
    return [f"{path}/portion={r.portion}" for r in dealt.select("portion").distinct().orderBy("portion").collect()]


#: The search tables a Python worker has built last, by folder and window.
_built: dict[tuple[str, int], WuManber] = {}


def _tables(folder: str | None, window: int) -> WuManber:
    """The tables of one portion, read from its folder; a worker keeps those of one portion."""
    if (folder, window) not in _built:
        _built.clear()
        items = []
        if folder is not None:
            store, path = filesystem(folder)
            rows = pq.read_table(path, columns=["item", "words"], filesystem=store, partitioning=None)
            items = [(i, w.split()) for i, w in zip(rows["item"].to_pylist(), rows["words"].to_pylist())]
        _built[folder, window] = WuManber(items, window)
    return _built[folder, window]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "hits array<struct<start:int,end:int>>, items array<string>"


def _columns(hits: list, items: list) -> list[pa.Array]:
    rows = [[{"start": a, "end": b} for a, b in spans] for spans in hits]
    return [pa.array(rows, _SPANS), pa.array(items, pa.list_(pa.string()))]


def _in_one_pass(docs: DataFrame, folder: str | None, window: int) -> DataFrame:
    keep = docs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(folder, window)
        for batch in slices(batches):
            counts, hits, items = [], [], []
            for text in text_column(batch, "text"):
                w = words(text)
                spans, found = tables.search(w)
                counts.append(len(w))
                hits.append(merged(spans))
                items.append(sorted(found))
            added = [pa.array(counts, pa.int64()), *_columns(hits, items)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + added, names=[*keep, "n_words", "hits", "items"])

    return docs.mapInArrow(search, _with_found(docs))


def _with_found(docs: DataFrame) -> StructType:
    return StructType([*docs.schema.fields, *StructType.fromDDL(f"n_words long, {_FOUND}").fields])


def _hit_rows(rows: DataFrame, folder: str, window: int) -> DataFrame:
    """(row, hits, items) of the rows in which a window of the portion occurs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(folder, window)
        for batch in slices(batches):
            numbers, hits, items = [], [], []
            for number, text in zip(batch.column("row").to_pylist(), text_column(batch, "text")):
                spans, found = tables.search(words(text))
                if spans:
                    numbers.append(number)
                    hits.append(merged(spans))
                    items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *_columns(hits, items)], names=["row", "hits", "items"])

    return rows.mapInArrow(search, f"row long, {_FOUND}")


def _in_passes(docs: DataFrame, folders: list[str], window: int) -> DataFrame:
    """One pass per portion, each leaving a table of its hit rows; then the hits meet their rows.

    The rows are written once, numbered; a pass reads numbers and texts alone.
    """
    keep = docs.columns
    number = "__row"
    while number in {c.lower() for c in keep}:
        number += "_"
    numbered = write_through(docs.withColumn(number, F.monotonically_increasing_id()), "searched")
    texts = numbered.select(F.col(number).alias("row"), "text")
    tables = [write_through(_hit_rows(texts, folder, window), "hits") for folder in folders]
    # At most one entry per portion and row.
    found = reduce(DataFrame.unionByName, tables).groupBy(F.col("row").alias(number)).agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [len(words(text)) for text in text_column(batch, "text")]
            hits = [merged([(s["start"], s["end"]) for s in spans or ()]) for spans in batch.column("hits").to_pylist()]
            items = [sorted(set(ids or ())) for ids in batch.column("items").to_pylist()]
            added = [pa.array(counts, pa.int64()), *_columns(hits, items)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + added, names=[*keep, "n_words", "hits", "items"])

    return numbered.join(found, number, "left").drop(number).mapInArrow(finish, _with_found(docs))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (merged word spans) and items (sorted ids of items found).

    A benchmark of one portion is searched for in place: rows are neither moved nor
    gathered. A larger one takes a pass per portion, and a worker holds the tables of one
    portion at a time, whatever the size of the benchmark.
    Null and empty texts have no words. Items without words match nothing; a
    null item_id counts as the id "null". Rows with repeated or null doc_ids
    are judged each on its own. Other columns pass through; columns of the
    names added here are replaced.
    """
    ship(docs.sparkSession)
    folders = portions(benchmark, window, pass_words)
    docs = docs.drop("n_words", "hits", "items")
    if len(folders) > 1:
        return _in_passes(docs, folders, window)
    return _in_one_pass(docs, folders[0] if folders else None, window)


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``found`` with n_hit, n_items, items_sha256 and contaminated (hit words are 1 / share or more)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
        "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
    })


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of (doc_id, text).

    An empty table of documents gives no rows; with an empty benchmark no word is hit. Very long
    texts are searched whole, in one task each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge(find(rows, benchmark)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    aside = set_aside(docs, "n_words", "hits", "items", "n_hit", "n_items", "items_sha256", "contaminated")
    return restored(judge(find(aside, benchmark)).where(~F.col("contaminated")), docs)


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_SQL_WORDS} AS w FROM documents)
, b AS (SELECT coalesce(cast(item_id AS varchar), 'null') AS item, {_SQL_WORDS} AS w FROM benchmark)
, windows AS (
  SELECT DISTINCT item, list_slice(w, i, least(i + 12, len(w))) AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
)
, sizes AS (SELECT DISTINCT len(p) AS k FROM windows)
, hits AS (
  SELECT n, i, k, item
  FROM (SELECT n, k, i, list_slice(w, i, i + k - 1) AS p
        FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k))
  JOIN windows USING (p)
)
, hit_words AS (SELECT n, count(*) AS n_hit FROM (SELECT DISTINCT n, unnest(range(i, i + k)) AS j FROM hits) GROUP BY n)
, found AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (n) LEFT JOIN found USING (n)
"""
