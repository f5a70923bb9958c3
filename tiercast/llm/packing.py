"""Concatenate and cut: fixed windows over the token stream of all documents.

Pass one encodes each document once, in doc_id order, and keeps its ids with
the tokens before it in its partition. Partition totals, summed up over the
few partitions, give every document its place in the whole stream without any
document meeting another. Pass two cuts the stream every ``length`` tokens; a
document that crosses a border gives one boundary record a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tiercast.sources.storage import write_through

from .common import ship, slices
from .tokens import encoded, in_id_order, vocabulary_path

LENGTH = 2048
END_ID = 1

_STREAM = pa.schema([
    ("part", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("doc_tokens", pa.int64()),
    ("width", pa.int32()), ("ids", pa.binary()),
])
_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def token_stream(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and ``place``, its first position in the whole stream."""
    ship(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for doc_ids, texts, enc in encoded(batches, vocabulary, end_id):
            counts = [len(ids) // enc.width for ids in texts]
            places = np.cumsum([first, *counts])
            first = int(places[-1])
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(places[:-1], pa.int64()),
                pa.array(counts, pa.int64()), pa.array([enc.width] * n, pa.int32()), pa.array(texts, pa.binary()),
            ], schema=_STREAM)

    staged = write_through(in_id_order(docs).mapInArrow(
        encode, "part long, doc_id long, first long, doc_tokens long, width int, ids binary"), "stream")
    totals = staged.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row a partition of the staged table: bounded by the number of tasks, whatever the data.
    return staged.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_tokens", "width", "ids", (F.col("base") + F.col("first")).alias("place"))


def pack(
    docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where a run of a document's ids lies in which sequence, and the ids (u32; null unless ``with_ids``).

    Sequence k holds stream positions [k * length, (k + 1) * length), so every
    sequence but the last is full. Null and empty texts hold the end id alone;
    null and repeated doc_ids keep all their rows; an empty table gives no
    piece. Columns beside doc_id and text are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for d in batch.to_pylist():
                ids = np.frombuffer(d["ids"], dtype=f"<u{d['width']}").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(d["place"] + start, length)
                    piece = ids[start : start + length - offset].tobytes()
                    rows.append((d["doc_id"], start, len(piece) // 4, zlib.crc32(piece), d["doc_tokens"], sequence, offset, piece if with_ids else None))
                    start += len(piece) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    return token_stream(docs, vocabulary, end_id).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.drop("ids")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, padded_length, ids u32): the packed windows themselves.

    Only the last window can be short. It is padded to ``length`` with
    ``pad_id``, but stays as it is if its token count is a power of two.
    A window gathers at most ``length`` ids, so no group is larger than that.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    packed = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    n = F.col("n_tokens")
    padded = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(length)).cast("long")
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.unhex(F.repeat(F.hex(F.lit(int(pad_id).to_bytes(4, "little"))), (F.col("padded_length") - n).cast("int")))
    return packed.withColumn("padded_length", padded).select(
        "sequence_id", "n_tokens", "padded_length", F.concat(joined, pad).alias("ids"))
