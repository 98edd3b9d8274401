"""WARC archives: a writer with one gzip member per record, and a reader that splits archives by byte range.

Writer: each task writes archives of its own names into the shared folder and reports them; the reports are
the manifest, so what failed or repeated tasks leave behind is never read. Of records with equal payloads
the one with the smallest id is a response and the rest revisit it.

Reader: each task takes byte ranges. In its range it looks for the gzip magic, decodes a candidate's header
to tell members from chance bytes, and checks that the members from there on follow one another up to the
range's end. It owns the records that start in the range, and reads on for the last one's rest.

Null payloads count as empty, null URLs are left out. A row with a null id gets a random record id; it is a
response only where no row of its payload has an id. Rows that repeat the smallest id of a payload are all
responses. Archives are read and written by ``pyarrow.fs``, so a shared folder is any URI that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: A task's archive is closed at this size and another begun.
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_RECORDS = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_RECORDS_ARROW = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
_MANIFEST = "path string, bytes long, records long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(identifier: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One response or revisit record, not yet compressed. A revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives every row of ``pages`` (page_id, url, html) below ``folder``; returns the written manifest: path, bytes, records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    typed = rows.join(first, "digest").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, first_id = (batch.column(i)[row].as_py() for i in range(4))
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                own = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                out.write(data := compressed(record(own, url, payload, None if first_id is None else f"urn:page:{first_id}", date)))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return written(typed.mapInArrow(run, _MANIFEST), f"{folder}/manifest")


class Record(NamedTuple):
    header: dict[str, str]
    body: bytes


def parsed(data: bytes) -> Record | None:
    """The record that a whole member holds, or None if it isn't one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        return None
    header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not REQUIRED <= header.keys() or not header["content-length"].isdigit() or len(rest) < (n := int(header["content-length"])):
        return None
    return Record(header, rest[:n])


class Archive:
    """An archive under a moving window of bytes; what lies before the window is forgotten."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """The bytes at ``offset``: n, or up to the end."""
        if not self.start <= offset <= offset + min(n, self.size - offset) <= self.start + len(self.data):
            self.source.seek(offset)
            self.start, self.data = offset, self.source.read(min(max(n, CHUNK), self.size - offset))
        return self.data[offset - self.start : offset - self.start + n]

    def looks_like_member(self, offset: int) -> bool:
        """Whether a gzip member with a WARC header starts here: the first bytes are decoded, no more."""
        if not (head := self.at(offset, 4096)).startswith(MAGIC):
            return False
        try:
            return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def member(self, offset: int) -> tuple[Record, int] | None:
        """The record of the member at ``offset`` and the offset after it; None if no whole record is there."""
        z, parts, at = zlib.decompressobj(31), [], offset
        try:
            while not z.eof:
                if not (chunk := self.at(at, 1 << 16)):
                    return None
                parts.append(z.decompress(chunk))
                at += len(chunk)
        except zlib.error:
            return None
        found = parsed(b"".join(parts))
        return found and (found, at - len(z.unused_data))

    def first(self, start: int, end: int) -> int | None:
        """The first record that starts in the range: from there, member follows member up to the range's end."""
        at = start
        while at < end:
            window = self.at(at, CHUNK)
            hit = window.find(MAGIC)
            if hit < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
            elif at + hit < end and self.looks_like_member(at + hit) and self.follows(at + hit, end):
                return at + hit
            else:
                at += hit + 1
        return None

    def follows(self, at: int, end: int) -> bool:
        while at < end:
            if not self.looks_like_member(at) or not (found := self.member(at)):
                return False
            at = found[1]
        return at >= self.size or self.looks_like_member(at)

    def records(self, start: int, end: int) -> Iterator[tuple[int, Record]]:
        at = self.first(start, end)
        while at is not None and at < end:
            found, after = self.member(at)
            yield at, found
            at = after


def _fields(path: str, offset: int, found: Record) -> tuple:
    bare = lambda k: v.strip("<>") if (v := found.header.get(k)) else None
    http, _, payload = found.body.partition(b"\r\n\r\n")
    kind = found.header["warc-type"]
    if kind == "revisit":
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
        digest = (bare("warc-payload-digest") or "").removeprefix("sha1:") or None
        return path, offset, bare("warc-record-id"), kind, bare("warc-target-uri"), bare("warc-refers-to"), digest, length, None
    payload = payload if http.startswith(b"HTTP/") else found.body
    return path, offset, bare("warc-record-id"), kind, bare("warc-target-uri"), None, sha1_base32(payload), len(payload), payload


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for every record of the archives (path, bytes). Revisits carry the digest and length they state, and no payload."""
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                store, where = fs.FileSystem.from_uri(x["path"])
                with store.open_input_file(where) as source:
                    rows, held = [], 0
                    for offset, found in Archive(source, x["bytes"]).records(x["start"], min(x["start"] + range_bytes, x["bytes"])):
                        rows.append(_fields(x["path"], offset, found))
                        held += len(found.body)
                        if held > 8 * CHUNK:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.repartition(min(int(n), 100_000), "path", "start").mapInArrow(run, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORDS_ARROW, strict=True)], schema=_RECORDS_ARROW)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read(write(pages, shared_dir(spark))).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: The same for DuckDB: five hexadecimal digits of a digest make four of base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> s) & 31) AS BIGINT), 1)))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b"""
