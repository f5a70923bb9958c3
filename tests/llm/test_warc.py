"""Archives: round trips, copies, and archives read without this library's index."""

import glob
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tiercast.llm import warc
from tiercast.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def expected(rows):
    """{(page_id, payload): (record_type, refers_to)} by comparing whole payloads."""
    first = {}
    for i, _, p in rows:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    return sorted(
        ((i, len(p), hashlib.sha256(p).hexdigest(), *(("response", None) if first.get(p, i) == i or p not in first else ("revisit", first[p])))
         for i, _, p in rows), key=str)


def as_bytes(rows):
    return [(r.page_id, r.url, (r.html or "").encode()) for r in rows]


def test_a_table_with_copies(spark):
    pages = read(spark, SF_DIR, "pages")
    copies = pages.where("page_id % 7 = 1").withColumn("page_id", F.col("page_id") + 10_000)
    pages = pages.unionByName(copies).unionByName(copies.withColumn("page_id", -F.col("page_id"))).repartition(5)
    archives = warc.write_archives(pages)
    assert sorted(map(tuple, warc.capture_digests(archives).collect()), key=str) == expected(as_bytes(pages.collect()))
    stored = {r.page_id: (r.url, bytes(r.payload)) for r in archives.records().where("record_type = 'response'").collect()}
    for r in pages.collect():
        if r.page_id in stored:
            assert stored[r.page_id] == (r.url, r.html.encode())
    revisits = archives.records().where("record_type = 'revisit'").select("refers_to").distinct().collect()
    assert revisits and all(r.refers_to in stored for r in revisits)


LONG = "<p>" + "x" * 200 + "</p>"
ODD = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (2, "http://a/2", LONG), (1, "http://a/again", LONG), (None, None, LONG),
    (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nWARC-Type: revisit", "short"), (6, "http://a/6", "short"),
    (7, "http://a/7", "é" * 50), (8, "http://a/8", "é" * 50), (9, "http://a/9", "e" * 99), (10, "http://a/10", "e" * 99),
    (None, "http://n/1", "n" * 150), (None, "http://n/2", "n" * 150), (11, "http://a/11", "\r\n\r\n" * 60), (12, "http://a/ü 漢", "\0" * 3_000_000),
]


def odd_pages(spark):
    return spark.createDataFrame(
        [(i, u, h, "d", "p", 1, 2) for i, u, h in ODD],
        "page_id long, url string, html string, digest string, payload string, size int, first int")


def test_odd_rows_and_clashing_columns(spark):
    archives = warc.write_archives(odd_pages(spark))
    assert sorted(map(tuple, warc.capture_digests(archives).collect()), key=str) == expected([(i, u, (h or "").encode()) for i, u, h in ODD])
    urls = {r.page_id: r.url for r in archives.records().where("page_id in (3, 5, 12)").collect()}
    assert urls == {3: None, 5: "http://a/5%0D%0AWARC-Type:%20revisit", 12: "http://a/ü%20漢"}


def test_an_empty_table(spark):
    archives = warc.write_archives(odd_pages(spark).limit(0))
    assert archives.index().count() == 0 and warc.capture_digests(archives).collect() == []


def test_archives_are_rolled_and_carry_their_dictionary(spark, tmp_path):
    pages = read(spark, SF_DIR, "pages")
    archives = warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), archive_bytes=1 << 13)
    files = sorted(glob.glob(f"{tmp_path}/w/archive-*.warc.zst"))
    assert len(files) > 1 and not glob.glob(f"{tmp_path}/w/.archive-0*")
    assert archives.records().count() == pages.count()
    for path in files:
        data = open(path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        assert shared.dict_id() != 0
    # One record by its offset alone.
    entry = archives.index().orderBy(F.desc("number"), F.desc("offset")).first()
    frame = open(warc._archive_file(f"{tmp_path}/w", entry.archive, entry.number), "rb").read()[entry.offset : entry.offset + entry.size]
    assert zstandard.get_frame_parameters(frame).dict_id == shared.dict_id()
    found = warc.parse(zstandard.ZstdDecompressor(dict_data=shared).decompress(frame, max_output_size=1 << 24))
    assert found["page_id"] == entry.page_id


def test_the_dictionary_saves_room(spark, tmp_path):
    pages = read(spark, SF_DIR, "pages").coalesce(1)
    sizes = [
        warc.write_archives(pages, str(tmp_path / str(k)), warc.Training(least=k)).index().agg(F.sum("size")).first()[0]
        for k in (20, 10**9)]
    assert sizes[0] < 0.9 * sizes[1]


def archive(dictionary=None):
    compressor = warc._compressor(dictionary, 3)
    payload = b"payload" * 30
    records = [warc.record(i, "http://x/", hashlib.sha256(payload).hexdigest(), len(payload), None, payload) for i in range(3)]
    return warc.archive_head(dictionary) + b"".join(map(compressor.compress, records)), records


def test_a_changed_or_missing_byte_is_found():
    data, records = archive()
    assert [r for _, r in warc.frames(io.BytesIO(data))] == records
    for at in range(0, len(data), 7):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(warc.BrokenArchive):
            found = [warc.parse(r) for _, r in warc.frames(io.BytesIO(bytes(broken)))]
            if len(found) != 3:  # a changed magic can turn a frame into one to skip
                raise warc.BrokenArchive
    with pytest.raises(warc.BrokenArchive):
        list(warc.frames(io.BytesIO(data[:-3])))


@pytest.mark.parametrize("change", [(b"response", b"resource"), (b"sha256:", b"sha256:0"), (b"Content-Length", b"Content-Lenght"), (b"payloadp", b"Payloadp")])
def test_records_that_contradict_themselves(change):
    _, records = archive()
    with pytest.raises(warc.BrokenArchive):
        warc.parse(records[0].replace(*change))
