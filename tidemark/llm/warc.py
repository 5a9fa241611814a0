"""WARC archives: write, normalise monolithic gzip, index, read back.

`write_archives` renders a record per page into archives that are one gzip stream each.
`normalise` inflates such a stream once, front to back in fixed-size pieces, rewrites every record as a gzip member of
its own and writes a sidecar index (JSON lines: offset, length, type, uri, digest) beside it, so that
`read_archives` can seek to any record. A record of any length passes through in pieces; only reading a record
back holds one payload.

Tasks write files under names of their own attempt; the checkpointed manifest names the files that count, so a task that
is run again after a lost executor leaves at most an unused file.

Of pages with equal payloads (by SHA-256) of at least `least_bytes` bytes, the smallest page id is a response, the others
revisit it. Defined cases: page ids are whole numbers (a table whose ids can't be read as such is an error); other columns, whatever their
names, are not read; null html is an empty payload; null urls and ids become empty; pages that repeat both the smallest id and
the payload are all responses; line breaks in urls are percent-encoded; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, checkpointed, mapped, scratch, spread

PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC needs a date; a fixed one keeps the archives reproducible.
DATE = "2025-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file:/x, file:///x, hdfs://..., or a plain path)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if refers_to is given."""
    clean = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    name = "" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Inflated:
    """A gzip stream (one member or several) as a stream of plain bytes, inflated once, in pieces."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.buffer, self.inflate, self.rest = source, bytearray(), zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Adds plain bytes to the buffer; False at the end."""
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            fed = self.inflate.unconsumed_tail or self.rest or self.source.read(PIECE)
            self.rest = b""
            if not fed:
                return False
            if plain := self.inflate.decompress(fed, PIECE):
                self.buffer += plain
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def copy(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a record")
            yield (part := self.take(min(n, len(self.buffer))))
            n -= len(part)


def normalise_stream(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = 3) -> int:
    """Every record of source as a gzip member of its own in target, a line of index for each; their number."""
    plain, offset, count = Inflated(source), 0, 0
    while (head := plain.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        told = headers(head)
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal length
            length += len(data)
            if data:
                target.write(data)

        put(member.compress(head))
        for part in plain.copy(int(told["content-length"])):
            put(member.compress(part))
        for _ in plain.copy(4):
            pass
        put(member.compress(b"\r\n\r\n"))
        put(member.flush())
        line = {"offset": offset, "length": length, "type": told["warc-type"], "uri": told.get("warc-target-uri", ""), "digest": told.get("warc-payload-digest", "")}
        index.write(json.dumps(line).encode() + b"\n")
        offset, count = offset + length, count + 1
    return count


def page_number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_member(member: bytes) -> dict:
    """Record fields and payload of one gzip member."""
    plain = zlib.decompress(member, 31)
    head, _, body = plain.partition(b"\r\n\r\n")
    told = headers(head)
    block = body[: int(told["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = told["warc-payload-digest"].removeprefix("sha1:")
    revisit = told["warc-type"] == "revisit"
    if not revisit and digest_of(payload) != stated:
        raise ValueError(f"payload digest of {told['warc-record-id']} differs")
    return {
        "page_id": page_number(told["warc-record-id"]),
        "url": told["warc-target-uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": int(headers(http)["content-length"]),
        "payload_digest": stated,
        "record_type": told["warc-type"],
        "refers_to": page_number(told.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null: a response). Payloads are not shuffled unless very many pages revisit."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    keyed = pages.withColumn("key", F.unhex(F.sha2("html", 256)))
    rows = checkpointed(keyed.filter(F.octet_length("html") >= least_bytes).select("page_id", "key"))
    firsts = rows.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = checkpointed(rows.join(spread(firsts), "key").filter("page_id <> refers_to").distinct())
    small = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(revisits) if small else revisits.hint("merge"), ["page_id", "key"], "left").drop("key")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes (page_id, url, html, refers_to) rows as monolithic gzip archives; checkpointed manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        out = None

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [count]})

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, squeeze, count, size = f"raw-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, html.encode(), refers_to)
                if part := squeeze.compress(data):
                    out.write(part)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return checkpointed(pages.select("page_id", "url", "html", "refers_to").transform(mapped, run, "path string, records long"))


def normalise(manifest: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Rewrites each archive of the manifest (path) record by record; checkpointed manifest (path, index_path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"warc-{uuid.uuid4().hex}"
                with (
                    system.open_input_stream(f"{base}/{path}", compression=None) as source,
                    system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as target,
                    system.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    count = normalise_stream(source, target, index, level)
                yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.gz"], "index_path": [f"{name}.idx"], "records": [count]})

    return checkpointed(manifest.select("path").transform(mapped, run, "path string, index_path string, records long"))


FIELDS = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(FIELDS), at_once: int = 4 << 20) -> DataFrame:
    """The records of normalised archives, each found by its index line; `columns` of FIELDS."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[FIELDS[k]]) for k in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                rows, size = [], 0
                with system.open_input_file(f"{base}/{path}") as data, system.open_input_stream(f"{base}/{index_path}", compression=None) as index:
                    for line in io.BufferedReader(index):
                        at = json.loads(line)
                        data.seek(at["offset"])
                        row = read_member(data.read(at["length"]))
                        rows.append({k: row[k] for k in columns})
                        size += 200 + (len(row["payload"] or b"") if "payload" in columns else 0)
                        if size >= at_once:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path", "index_path").transform(mapped, run, ", ".join(f"{k} {FIELDS[k]}" for k in columns))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, normalises them, and reads every record back."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = normalise(write_archives(mark_revisits(pages, least_bytes), folder), folder)
    return read_archives(manifest, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
