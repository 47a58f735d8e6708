"""WARC archives of web pages, and a globally ordered index of their captures.

Each record is a gzip member of its own. Tasks pack members into archives of bounded size, and
Spark's text writer lays down one archive per file; the line end it adds is a zero byte, which
gzip readers skip as padding. Reading back goes member by member, and a member can be read
alone from its offset. Each archive gives a run of captures sorted by URL key and time; ranges
of the key space are then merged, all runs of a range at once, by a tree of losers.

Payloads are known by SHA-1, a second hash of 64 bits and their length. Which pages revisit
others follows from these alone, without the payloads.

Defined cases: null html is an empty payload; a null URL leaves out the header and has the
empty key; line breaks in URLs are percent-encoded; a null page_id counts as smaller than
any other; rows that repeat the largest page_id of a payload are all responses; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder, table

#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 0
#: An archive is closed once it holds so many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32_000_000, 20_000
#: Revisits (some 60 bytes each) that go to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Captures that a range of the merged index holds, about.
RANGE_ROWS = 50_000
_KEY = ["sha1", "second", "n_bytes"]
_EPOCH = 1_700_000_000  # capture time of page 0; page n is captured n seconds later


def base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a 20-byte digest: 60, 60 and 40 bits in digits of base 32, then the letters of RFC 4648."""
    digits = [F.lpad(F.conv(F.substring(F.hex(sha1), at, n), 16, 32), letters, "0") for at, n, letters in ((1, 15, 12), (16, 15, 12), (31, 10, 8))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1, second, n_bytes) of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha1"), F.xxhash64(payload).alias("second"), F.octet_length(payload).cast("bigint").alias("n_bytes"))


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, sha1, second, n_bytes, refers_to) of the pages whose payload a page with a larger id has too."""
    light = materialise(with_digest(pages).select("page_id", *_KEY), "digests")
    groups = light.where(F.col("n_bytes") >= least).groupBy(*_KEY).agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"), F.count("*").alias("n"), F.count("page_id").alias("ids"))
    shared = groups.where("refers_to is not null and (first < refers_to or ids < n)").select(*_KEY, "refers_to")
    older = light.join(shared, _KEY).where("page_id is null or page_id < refers_to")
    return materialise(older.select("page_id", *_KEY, "refers_to").distinct(), "revisits")


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(head, payload) of one WARC record per row of ``pages``, without its final line breaks; a revisit has no payload."""
    older = revisits(pages, least)
    if older.count() <= BROADCAST_ROWS:
        older = F.broadcast(older)
    known = with_digest(pages)
    rows = known.join(older, known["page_id"].eqNullSafe(older["page_id"]) & reduce(Column.__and__, [known[c] == older[c] for c in _KEY]), "left").select(*known, "refers_to")
    revisit, line = F.col("refers_to").isNotNull(), "\r\n"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n_bytes"), F.lit(line * 2))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    fields = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:unknown>")),
        "WARC-Date": F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + _EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32(F.col("sha1"))),
        "WARC-Refers-To": urn(F.col("refers_to")),
        "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": (F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string"),
    }
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(line))).otherwise("") for k, v in fields.items()]
    return rows.select(F.concat(F.lit(f"WARC/1.1{line}"), *lines, F.lit(line), head).alias("head"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> None:
    """Write ``pages`` as archives, each a file of ``folder``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for head, payload in zip(*(b.column(c).cast(pa.binary()) for c in ("head", "payload"))):
                held.append(gzip.compress(head.as_py() + (payload.as_py() or b"") + b"\r\n\r\n", 6, mtime=0))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES or len(held) == ARCHIVE_RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    archives = records(pages, least).mapInArrow(pack, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the last to the first, then path and query."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    shown = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){u.path or '/'}{'?' + u.query if u.query else ''}"


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parse(archive: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, each with a digest and length checked against its payload."""
    at = 0
    while first := archive.readline():
        if first.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"no record at {at}")
        size, fields = len(first), {}
        while (raw := archive.readline()).rstrip(b"\r\n"):
            size += len(raw)
            k, _, v = raw.decode("utf-8").partition(":")
            fields[k.lower()] = v.strip()
        block = archive.read(int(fields["content-length"]))
        archive.read(4)
        size += len(raw) + len(block) + 4
        head, _, payload = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"damaged payload at {at}")
        page, old = _PAGE.match(fields["warc-record-id"]), _PAGE.match(fields.get("warc-refers-to", ""))
        yield {
            "url_key": url_key(fields.get("warc-target-uri")), "captured_at": fields["warc-date"], "page_id": int(page[1]) if page else None, "payload_bytes": n,
            "payload_digest": digest, "record_type": kind, "refers_to": int(old[1]) if old else None, "offset": at,
        }
        at += size


def members(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """Where each gzip member of an archive begins, and what it holds."""
    at = 0
    while at < len(content):
        if content[at] == 0:  # padding
            at += 1
            continue
        d, start, out = zlib.decompressobj(31), at, []
        while not d.eof:
            if at >= len(content):
                raise ValueError(f"cut member at {start}")
            out.append(d.decompress(content[at : at + 65_536]))
            at = min(at + 65_536, len(content)) - len(d.unused_data)
        yield start, b"".join(out)


def order(r: dict) -> tuple:
    return (r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0, r["payload_digest"])


_INDEX = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("archive", pa.string())])
_INDEX_DDL = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, archive string"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive, sorted within it by URL key and time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                own = sorted((r | {"offset": at} for at, x in members(memoryview(content.as_buffer())) for r in parse(io.BytesIO(x))), key=order)
                if own:
                    yield pa.RecordBatch.from_pylist([r | {"archive": path.as_py()} for r in own], schema=_INDEX)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content").mapInArrow(work, _INDEX_DDL)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the overall winner stands apart."""

    def __init__(self, own: list[Iterable[dict]], key=order):
        self.runs, self.key, self.k = [iter(r) for r in own], key, len(own)
        self.heads: list[tuple | None] = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k else -1

    def _next(self, i: int) -> tuple | None:
        r = next(self.runs[i], None)
        return None if r is None else (self.key(r), i, r)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        """The winner below ``node``; nodes from k on are the runs."""
        order, won = [node], {}
        while order:
            n = order[-1]
            if n >= self.k:
                won[order.pop()] = n - self.k
            elif 2 * n not in won:
                order.append(2 * n)
            elif 2 * n + 1 not in won:
                order.append(2 * n + 1)
            else:
                a, b = won.pop(2 * n), won.pop(2 * n + 1)
                won[order.pop()], self.losers[n] = (a, b) if self._beats(a, b) else (b, a)
        return won[node]

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][2]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _rows(run: pa.Table) -> Iterator[dict]:
    """The rows of a run, some at a time."""
    for at in range(0, run.num_rows, 64):
        yield from run.slice(at, 64).to_pylist()


def merged_index(sorted_runs: DataFrame) -> DataFrame:
    """All captures in order of URL key and time. Ranges of the whole order, so that one URL's captures can fall into
    several, hold a piece of each run, archive by archive in its order; a range merges its pieces, of which it holds
    the columns, and the heads as rows."""
    places = ["url_key", "captured_at", "page_id", "payload_digest", "archive", "offset"]
    n = -(-sorted_runs.count() // RANGE_ROWS)
    ranged = sorted_runs.repartitionByRange(max(n, 1), *places).sortWithinPartitions("archive", *places)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, _INDEX)
        names = whole.column("archive").combine_chunks().dictionary_encode() if whole.num_rows else None
        codes = names.indices.to_numpy() if names is not None else np.zeros(0, int)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        out: list[dict] = []
        for r in LoserTree([_rows(whole.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]):
            out.append(r)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=_INDEX)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_INDEX)

    return ranged.mapInArrow(work, _INDEX_DDL)


def archive_and_index(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (default: a new one in the shared folder) and index what they hold."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return merged_index(materialise(runs(spark, folder), "captures"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) AS integer) // [32768, 1024, 32, 1][i % 4 + 1]) % 32 AS integer) + 1, 1)
    FOR i IN range(32)], 'string_agg', '') AS payload_digest
  FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM g
"""
