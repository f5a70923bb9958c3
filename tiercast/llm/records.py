"""Length-delimited binary records of token ids, with an offset index.

Each shard file is a run of records:

    length    u64   bytes of the payload
    check     u32   masked crc32 of the length bytes
    payload   doc_id i64, has_id u8, width u8, ids little-endian ``width`` bytes each
    check     u32   masked crc32 of the payload

A masked checksum is ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32, so that
checksums of data that itself holds checksums stay apart. The index is a table
beside the shards: (shard, row, offset, size, first, n_tokens), where ``first``
counts the tokens before the record inside its shard. Any subset or order of
records can be read through it without touching the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tiercast.sources.storage import fresh_path

from .common import filesystem, ship
from .tokens import encoded, in_id_order, vocabulary_path

_HEAD = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_ABOUT = struct.Struct("<qBB")
_INDEX = pa.schema([(n, pa.int64()) for n in ("shard", "row", "offset", "size", "first", "n_tokens")])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
#: Records read from a shard before their rows go on; bounds a worker's memory.
READ_ROWS = 256


class BrokenRecord(ValueError):
    """A record whose checksums, lengths or index entry do not agree."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _ABOUT.pack(doc_id or 0, doc_id is not None, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """The id and token ids of one record; raises BrokenRecord if anything is off."""
    if len(record) < _HEAD.size + _ABOUT.size + _CHECK.size:
        raise BrokenRecord("record is cut off")
    length, check = _HEAD.unpack_from(record)
    payload = record[_HEAD.size : -_CHECK.size]
    if check != masked(record[:8]) or length != len(payload):
        raise BrokenRecord("length does not agree")
    if _CHECK.unpack_from(record, len(record) - _CHECK.size)[0] != masked(payload):
        raise BrokenRecord("payload does not agree")
    doc_id, has_id, width = _ABOUT.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_ABOUT.size)
    return (doc_id if has_id else None), ids.astype("<u4")


def _shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.rec"


@dataclass
class RecordSet:
    """Shards below ``folder`` and the index table beside them."""

    spark: SparkSession
    folder: str

    def index(self) -> DataFrame:
        """The index with ``start``: the tokens of all records before, over all shards.

        Shard totals are summed first; the running sum goes over one row a shard.
        """
        index = self.spark.read.parquet(f"{self.folder}/index")
        totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
        before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
        # One row a shard: bounded by the number of write tasks, whatever the data.
        return index.join(F.broadcast(bases), "shard").select(
            "shard", "row", "offset", "size", "n_tokens", (F.col("base") + F.col("first")).alias("start"))

    def read(self, index: DataFrame | None = None) -> DataFrame:
        """(doc_id, start, n_tokens, ids little-endian u32), checked, in the order of ``index``.

        Without an index one task reads each shard from front to end. Pass an
        ordered, filtered or shuffled index to read in that order.
        """
        ship(self.spark)
        if index is None:
            shards = self.spark.read.parquet(f"{self.folder}/index").agg(F.max("shard")).first()[0]
            by_shard = self.index().repartitionByRange((shards or 0) + 1, "shard")
            index = by_shard.sortWithinPartitions("shard", "row")
        folder = self.folder

        def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = filesystem(folder)
            opened, handle = None, None
            for batch in batches:
                for s in range(0, batch.num_rows, READ_ROWS):
                    rows = []
                    for e in batch.slice(s, READ_ROWS).to_pylist():
                        if opened != e["shard"]:
                            if handle is not None:
                                handle.close()
                            opened, handle = e["shard"], store.open_input_file(_shard_file(root, e["shard"]))
                        doc_id, ids = unframe(handle.read_at(e["size"], e["offset"]))
                        if len(ids) != e["n_tokens"]:
                            raise BrokenRecord("index does not agree")
                        rows.append((doc_id, e["start"], len(ids), ids.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
            if handle is not None:
                handle.close()

        return index.select("shard", "offset", "size", "n_tokens", "start").mapInArrow(
            read_back, "doc_id long, start long, n_tokens long, ids binary")


def write_records(
    docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 0,
) -> RecordSet:
    """Write every document as one record, in ascending doc_id order, and the index.

    Null and empty texts give a record of the end id alone. A null doc_id comes
    first and reads back as null. Repeated ids and rows each keep their record,
    ordered by text; an empty table gives no shard and an empty index. Columns
    beside doc_id and text are ignored. A partition is one shard. A task writes
    under a name of its own attempt and renames it, so that a lost or repeated
    task leaves a whole shard of the same bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "records")
    vocabulary = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        unfinished = f"{root}/.shard-{shard:06d}-{task.taskAttemptId()}"
        offset = row = first = 0
        with store.open_output_stream(unfinished) as sink:
            for doc_ids, texts, enc in encoded(batches, vocabulary, end_id):
                entries = []
                for doc_id, ids in zip(doc_ids, texts):
                    record = frame(doc_id, ids, enc.width)
                    sink.write(record)
                    entries.append((shard, row, offset, len(record), first, len(ids) // enc.width))
                    offset, row, first = offset + len(record), row + 1, first + entries[-1][-1]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*entries)], schema=_INDEX)
        if row:
            store.move(unfinished, _shard_file(root, shard))
        else:
            store.delete_file(unfinished)

    index = in_id_order(docs).mapInArrow(write, "shard long, row long, offset long, size long, first long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return RecordSet(spark, folder)


def record_digests(records: RecordSet) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the files."""
    return records.read().select(
        "doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
