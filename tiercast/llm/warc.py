"""WARC archives compressed with a shared Zstandard dictionary.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, itself
a Zstandard frame, and then one frame a record, so that a record can be read
from its offset alone, and a whole archive from front to end without any index.
The dictionary is trained once, on a bounded sample of the records to be
written. A payload seen before is not stored again: its record is a ``revisit``
with the HTTP head only, which names the record that holds the payload.

Copies are found by SHA-256 in Spark. Only digests that occur more than once
are joined to the pages; partial counts combine before the shuffle, and Spark
can split a digest that a third of the pages share.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tiercast.sources.storage import fresh_path, write_through

from .common import drawn, filesystem, ship
from .tokens import by_bytes

#: Payloads of fewer bytes are always stored.
SMALLEST = 100
#: An archive that has grown beyond this is closed, and the next one begun.
ARCHIVE_BYTES = 1 << 30
#: Bytes of payload whose records are handed on together, and bytes read at once.
_SLICE, _FEED = 8 << 20, 16 << 10

# The frame of a dictionary, and the profile of a revisit record.
_SKIPPABLE = struct.Struct("<II")
_DICTIONARY_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema([
    ("archive", pa.int64()), ("number", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64())])
_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.int64()), ("number", pa.int32()),
    ("offset", pa.int64()), ("payload", pa.binary())])
_READ_TYPES = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive long, number int, offset long, payload binary")


class BrokenArchive(ValueError):
    """An archive that is cut off or whose records do not agree with themselves."""


@dataclass(frozen=True)
class Training:
    """The dictionary: its size, and the sample it is trained on.

    About ``records`` different payloads are drawn by hash, none longer than ``longest`` bytes; with
    fewer than ``least`` there is no dictionary and no leading frame.
    """

    size: int = 64 << 10
    records: int = 400
    longest: int = 32 << 10
    least: int = 20
    level: int = 3


# --- one record ---------------------------------------------------------------


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def _plain(url: str) -> str:
    """The URL as one header line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(
    page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes | None,
    date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """A response record with its payload, or, with ``payload`` None, a revisit of the record of ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _plain(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Page-ID", page_id),
    ]
    if payload is None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-ID", refers_to)]
    fields.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> dict:
    """What a record says, its digests and lengths checked; raises BrokenArchive if anything is off."""
    try:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = _fields(head)
        length = int(fields["Content-Length"])
        block, end = rest[:length], rest[length:]
        http, _, payload = block.partition(b"\r\n\r\n")
        size, kind = int(_fields(http)["Content-Length"]), fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("Page-ID", "Refers-To-Page-ID"))
        sound = head.startswith(b"WARC/1.1\r\n") and len(block) == length and end == b"\r\n\r\n"
    except (KeyError, ValueError) as e:
        raise BrokenArchive(f"not a record: {e}") from e
    if not sound or kind not in ("response", "revisit"):
        raise BrokenArchive("record is cut off or of an unknown kind")
    if kind == "revisit":
        payload = None
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise BrokenArchive("payload does not agree with its digest")
    return {
        "page_id": page_id, "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": refers_to, "payload": payload}


# --- one archive --------------------------------------------------------------


def archive_head(dictionary: bytes | None) -> bytes:
    """The leading skippable frame with the compressed dictionary; nothing without one."""
    import zstandard

    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return _SKIPPABLE.pack(_DICTIONARY_MAGIC, len(packed)) + packed


def _compressor(dictionary: bytes | None, level: int):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared is not None:
        shared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)


def frames(source) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive read from front to end; holds one record at a time."""
    import zstandard

    head = source.read(_SKIPPABLE.size)
    at, shared = 0, None
    if len(head) == _SKIPPABLE.size and _SKIPPABLE.unpack(head)[0] == _DICTIONARY_MAGIC:
        packed = source.read(_SKIPPABLE.unpack(head)[1])
        at = len(head) + len(packed)
        try:
            shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        except zstandard.ZstdError as e:
            raise BrokenArchive("the dictionary cannot be read") from e
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    fed = head or source.read(_FEED)
    while fed:
        frame, parts, start = decompressor.decompressobj(), [], at
        while not frame.eof:
            if not fed and not (fed := source.read(_FEED)):
                raise BrokenArchive("archive ends inside a record")
            try:
                parts.append(frame.decompress(fed))
            except zstandard.ZstdError as e:
                raise BrokenArchive(f"frame at {start} cannot be read") from e
            at += len(fed) - len(frame.unused_data)
            fed = frame.unused_data
        yield start, b"".join(parts)
        fed = fed or source.read(_FEED)


def _archive_file(folder: str, archive: int, number: int) -> str:
    return f"{folder}/archive-{archive:06d}-{number:04d}.warc.zst"


@dataclass
class ArchiveSet:
    """Archives below ``folder`` and, beside them, the index of their records."""

    spark: SparkSession
    folder: str

    def index(self) -> DataFrame:
        """(archive, number, offset, size, page_id) of every record."""
        return self.spark.read.parquet(f"{self.folder}/index")

    def records(self, payloads: bool = True) -> DataFrame:
        """Every record as read from the archives, one task a file; without ``payloads`` these are checked and left out."""
        ship(self.spark)
        files = self.index().select("archive", "number").distinct()
        ranges = files.repartitionByRange(max(files.count(), 1), "archive", "number")
        folder = self.folder

        def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = filesystem(folder)
            for archive, number in ((r["archive"], r["number"]) for b in batches for r in b.to_pylist()):
                with store.open_input_stream(_archive_file(root, archive, number), compression=None) as source:
                    rows, held = [], 0
                    for offset, data in frames(source):
                        row = parse(data) | {"archive": archive, "number": number, "offset": offset}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > _SLICE:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)

        return ranges.mapInArrow(read_back, _READ_TYPES)


# --- a table of pages ---------------------------------------------------------


def _captures(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def _trained(captures: DataFrame, different: int, how: Training) -> bytes | None:
    """The dictionary, from about ``how.records`` of the ``different`` payloads that are long enough to repeat."""
    import zstandard

    share = min(1.0, how.records / max(different, 1))
    fit = captures.where(F.col("size").between(SMALLEST, how.longest) & drawn(share, "digest"))
    sample = fit.groupBy("digest", "size").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.any_value("payload").alias("payload")).collect()
    if len(sample) < how.least:
        return None
    records = [
        record(r.first["page_id"], r.first["url"], r.digest, r["size"], None, bytes(r.payload))
        for r in sorted(sample, key=lambda r: r.digest)]
    try:
        return zstandard.train_dictionary(how.size, records).as_bytes()
    except zstandard.ZstdError:  # records too short or too alike
        return None


def write_archives(
    pages: DataFrame, folder: str | None = None, training: Training = Training(), archive_bytes: int = ARCHIVE_BYTES,
) -> ArchiveSet:
    """Write every row of ``pages`` (page_id, url, html) as one record, and the index.

    Of equal payloads of at least ``SMALLEST`` bytes, rows with the smallest
    page_id are responses and the others revisit it. Rows that repeat that id are
    responses, too; a null id is never the smallest, unless all are null: then
    all rows are responses. A null html is an empty payload, a null url is left
    out, control characters and spaces of a url are percent-encoded. An empty table gives no
    archive and an empty index. Other columns are ignored. A task writes under a
    name of its own attempt and renames the file when whole.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    captures = _captures(pages)
    counted = Observation()
    groups = (
        captures.where(F.col("size") >= SMALLEST).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .observe(counted, F.count(F.lit(1)).alias("different"))
    )
    # Staged, so that Spark knows its size: it stays small or is joined by shuffle, as its files tell.
    repeated = write_through(groups.where("copies > 1").select("digest", "first"), "repeated")
    dictionary = _trained(captures, counted.get.get("different") or 0, training)
    head, level = archive_head(dictionary), training.level

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, number, sink, offset = task.partitionId(), 0, None, 0
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        unfinished = f"{root}/.archive-{archive:06d}-{task.taskAttemptId()}"
        compressor = _compressor(dictionary, level)
        for batch in by_bytes(batches, "payload", _SLICE):
            entries = []
            for r in batch.to_pylist():
                if sink is None:
                    sink, offset = store.open_output_stream(f"{unfinished}-{number}", compression=None), len(head)
                    sink.write(head)
                data = compressor.compress(record(
                    r["page_id"], r["url"], r["digest"], r["size"], r["refers_to"],
                    None if r["refers_to"] is not None else r["payload"] or b""))
                sink.write(data)
                entries.append((archive, number, offset, len(data), r["page_id"]))
                offset += len(data)
                if offset >= archive_bytes:
                    sink.close()
                    store.move(f"{unfinished}-{number}", _archive_file(root, archive, number))
                    number, sink = number + 1, None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), _INDEX)], schema=_INDEX)
        if sink is not None:
            sink.close()
            store.move(f"{unfinished}-{number}", _archive_file(root, archive, number))

    elsewhere: Column = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = captures.join(repeated, "digest", "left").withColumn("refers_to", elsewhere)
    stored = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows.select("page_id", "url", "digest", "size", "refers_to", stored.alias("payload")).mapInArrow(
        write, "archive long, number int, offset long, size long, page_id long").write.parquet(f"{folder}/index")
    return ArchiveSet(spark, folder)


def capture_digests(archives: ArchiveSet) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the archives."""
    return archives.records(payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
