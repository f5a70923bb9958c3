"""URL rules in a sorted digest array.

A rule set is one file: the 64-bit xxhash of every rule's ``host/path`` text in
ascending order, then the offsets of the stored texts, verdicts and the texts
themselves. Executors map it into memory. A url asks for each host suffix
joined with each prefix of its path that some rule has the length of; all
digests of a batch are probed by one vectorised binary search, and a hit counts
only if the stored text is the one asked for, so that a collision of digests
cannot decide.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tiercast.sources.storage import fresh_path

from .common import filesystem, ship

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict); a rule holds for its host and all subdomains, where the url's path starts with the rule's.
RULES = (
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
)
_HEAD = struct.Struct("<4sQQQ")
_MAGIC = b"URLD"
#: Urls probed by one binary search.
PROBE = 4096


def _text(host: str, path: str) -> bytes:
    return (host.translate(_LOWER) + path).encode("utf-8", "replace")


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def write_digests(path: str, rules: Iterable[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> None:
    """Write the digest file of ``rules``. Of two rules with the same text the blocking one counts."""
    verdicts: dict[bytes, int] = {}
    for host, rule_path, verdict in rules:
        text = _text(host, rule_path)
        verdicts[text] = verdicts.get(text, 0) | (verdict == BLOCK)
    rows = sorted((digest(t), t, v, t.find(b"/") if b"/" in t else len(t)) for t, v in verdicts.items())
    lengths = np.unique(np.array([len(t.decode()) - len(t[:cut].decode()) for _, t, _, cut in rows], np.int64))
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64)
    with open(path, "wb") as f:
        f.write(_HEAD.pack(_MAGIC, len(rows), len(lengths), int(ends[-1])))
        f.write(np.array([r[0] for r in rows], np.uint64).tobytes())
        f.write(ends.tobytes())
        f.write(lengths.tobytes())
        f.write(bytes(r[2] for r in rows))
        f.write(b"".join(r[1] for r in rows))


class Digests:
    """A digest file mapped into memory."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        with open(path, "rb") as f:
            magic, self.n, lengths, size = _HEAD.unpack(f.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a digest file")
        at = _HEAD.size
        mapped = lambda dtype, n, start: np.memmap(path, dtype, "r", start, (n,)) if n else np.empty(0, dtype)
        self.keys = mapped(np.uint64, self.n, at)
        self.ends = mapped(np.int64, self.n + 1, at := at + 8 * self.n)
        self.lengths = np.array(mapped(np.int64, lengths, at := at + 8 * (self.n + 1))).tolist()
        self.blocks = mapped(np.uint8, self.n, at := at + 8 * lengths)
        self.texts = mapped(np.uint8, size, at + self.n)
        self.longest = int(np.diff(self.ends).max(initial=0))
        self._digest = digest

    def _same(self, at: int, text: bytes) -> bool:
        return self.texts[self.ends[at] : self.ends[at + 1]].tobytes() == text

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """(rule text or None, verdict) of each (host, path): the longest rule that fits, else allow.

        Of fitting rules of one length the one with the longer host wins.
        """
        asked, owner = [], []
        for i, (host, path) in enumerate(urls):
            start = len(host) + 1
            while start > 0:  # suffixes of whole labels, none longer than any rule
                start = host.rfind(".", 0, start - 1) + 1
                if len(host) - start > self.longest:
                    break
                suffix = host[start:]
                for n in self.lengths:
                    if suffix and n <= len(path):
                        asked.append((suffix + path[:n]).encode("utf-8", "replace"))
                        owner.append((i, n, len(suffix)))
        found: list[tuple] = [None] * len(urls)
        keys = np.array([self._digest(t) for t in asked], np.uint64)
        at = np.searchsorted(self.keys, keys, side="left")
        for k in np.flatnonzero(np.append(self.keys, np.uint64(0))[at] == keys):
            a, text = int(at[k]), asked[k]
            while a < self.n and self.keys[a] == keys[k]:  # rules whose digests collide lie side by side
                if self._same(a, text):
                    i, n, host = owner[k]
                    rank = (n + host, host)
                    if found[i] is None or rank > found[i][0]:
                        found[i] = rank, text.decode(), BLOCK if self.blocks[a] else ALLOW
                    break
                a += 1
        return [(None, ALLOW) if f is None else f[1:] for f in found]


_opened: dict[str, Digests] = {}


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """Write the digest file of ``rules`` to the shared folder, where every executor finds it; returns its path."""
    shared = fresh_path(spark, "url-digests")
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "digests")
        write_digests(path, rules)
        store, target = filesystem(shared)
        store.create_dir(os.path.dirname(target), recursive=True)
        fs.copy_files(path, target, source_filesystem=fs.LocalFileSystem(), destination_filesystem=store)
    return shared


def opened(path: str) -> Digests:
    """The digest file, mapped where it lies or, from a remote store, as a copy of this worker's own."""
    if path not in _opened:
        store, source = filesystem(path)
        if not isinstance(store, fs.LocalFileSystem):
            handle, local = tempfile.mkstemp(prefix="url-digests-")
            os.close(handle)
            fs.copy_files(source, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            source = local
        _opened[path] = Digests(source)
    return _opened[path]


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of its column ``url``.

    Null urls and urls without :// have empty host and path, fit no rule and
    are allowed. Repeated rows are judged alike. Other columns pass through;
    columns of the four names are replaced. An empty rule set allows all.
    """
    ship(pages.sparkSession)
    name = publish(pages.sparkSession, rules)
    rows = pages.drop("host", "path", "rule", "verdict")
    url = F.col("url").cast("string")
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url), "rule": F.lit(None).cast("string"), "verdict": F.lit(ALLOW)})
    keep = rows.columns[:-2]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = opened(name)
        for batch in batches:
            for s in range(0, batch.num_rows, PROBE):
                part = batch.slice(s, PROBE)
                urls = list(zip(part.column("host").to_pylist(), part.column("path").to_pylist()))
                found, verdicts = zip(*digests.judge(urls))
                added = [pa.array(found, pa.string()), pa.array(verdicts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *added], names=[*keep, "rule", "verdict"])

    return rows.mapInArrow(judged, rows.schema)


def verdicts(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; an empty table gives no rows."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return judge(rows, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), numbered AS (SELECT row_number() OVER () AS n, * FROM cut)
, best AS (
  SELECT n, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
    arg_max(verdict, (length(rule_host || rule_path), length(rule_host))) AS verdict
  FROM numbered JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (n)
"""
