"""WARC archives: write them, turn whole-file gzip into one member a record with an offset index, read them back.

Archives are kept as rows (archive_id, content) of a table, since a cluster's store may be one that only Spark writes to;
normalise_stream works on file objects, for archives that lie in files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

LEVEL = 4
CHUNK = 1 << 16
RECORDS = "archive_id string, content binary"
INDEXED = "archive_id string, content binary, index array<struct<record_id:string, offset:bigint, length:bigint>>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head, whose Content-Length is that of the full payload, and no body."""
    clean = None if url is None else "".join(c if c > "\x20" else f"%{ord(c):02X}" for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean}"] if clean is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a head, names in lower case."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in pieces of bounded size."""
    unzip = zlib.decompressobj(31)
    while piece := source.read(CHUNK):
        while piece:
            yield unzip.decompress(piece, CHUNK * 4)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, CHUNK * 4)
            piece = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    if rest := unzip.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, the whole record's bytes) of each record; no more than one record is held. A cut-off record is an error."""
    held, begin = bytearray(), 0
    while True:
        while (end := held.find(b"\r\n\r\n", begin)) < 0:
            if (piece := next(pieces, None)) is None:
                if held[begin:].strip():
                    raise ValueError("the archive ends within a head")
                return
            del held[:begin]
            begin = 0
            held += piece
        head = fields(bytes(held[begin:end]))
        whole = end + 4 + int(head["content-length"]) + 4
        while len(held) < whole:
            if (piece := next(pieces, None)) is None:
                raise ValueError("the archive ends within a record")
            held += piece
        yield head, bytes(held[begin:whole])
        begin = whole


def normalise_stream(source: BinaryIO, target: BinaryIO) -> list[tuple[str, int, int]]:
    """Rewrite a gzip archive with each record as its own member. Returns the sidecar index: (record id, offset, length)."""
    index, at = [], 0
    for head, raw in records(inflated(source)):
        member = gzip.compress(raw, LEVEL, mtime=0)
        target.write(member)
        index.append((head["warc-record-id"], at, len(member)))
        at += len(member)
    return index


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_archives(pages: DataFrame, size: int = 8 << 20, date: str = "1970-01-01T00:00:00Z", least: int = 1000) -> DataFrame:
    """Archives of page_id, url, html: each a single gzip stream of about `size` bytes of records.

    Of pages with equal payloads of `least` bytes or more, the one with the largest page_id is the response and the rest
    revisit it. The heavy column moves once, by page_id; payload groups meet as (page_id, digest) only, and the largest id
    of a group is found by partial aggregation, so a payload of a third of all pages is no single task's work."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    revisits = large.join(last, "digest").where("page_id <> refers_to").distinct()

    def write(batches):
        part, made, zipper, out, held = TaskContext.get().partitionId(), 0, None, io.BytesIO(), 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                zipper = zipper or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(page_id, url, html.encode(), digest, refers_to, date)
                out.write(zipper.compress(raw))
                held += len(raw)
                if held >= size:
                    out.write(zipper.flush())
                    yield pa.RecordBatch.from_pydict({"archive_id": pa.array([f"{part:06d}-{made:05d}"]), "content": pa.array([out.getvalue()], pa.binary())})
                    made, zipper, out, held = made + 1, None, io.BytesIO(), 0
        if zipper:
            out.write(zipper.flush())
            yield pa.RecordBatch.from_pydict({"archive_id": pa.array([f"{part:06d}-{made:05d}"]), "content": pa.array([out.getvalue()], pa.binary())})

    return pages.join(revisits, ["page_id", "digest"], "left").mapInArrow(write, RECORDS)


def normalise(archives: DataFrame) -> DataFrame:
    """archives with each record as its own gzip member, and the sidecar index of offsets."""

    def rewrite(batches):
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, content in zip(batch.column("archive_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                index = normalise_stream(io.BytesIO(content), out := io.BytesIO())
                yield pa.RecordBatch.from_pydict({"archive_id": pa.array([name]), "content": pa.array([out.getvalue()], pa.binary()), "index": pa.array([[dict(zip(("record_id", "offset", "length"), x, strict=True)) for x in index]], kind)})

    return archives.mapInArrow(rewrite, INDEXED)


def read_records(indexed: DataFrame) -> DataFrame:
    """The records of normalised archives, each by its own place in the index."""
    names = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}

    def read(batches):
        for batch in batches:
            for content, index in zip(batch.column("content").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows = []
                for entry in index:
                    raw = gzip.decompress(content[entry["offset"] : entry["offset"] + entry["length"]])
                    begin = raw.index(b"\r\n\r\n") + 4
                    head = fields(raw[: begin - 4])
                    body = raw[begin : begin + int(head["content-length"])]
                    http, _, payload = body.partition(b"\r\n\r\n")
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != said:
                            raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                    else:
                        n, digest = int(fields(http)["content-length"]), said
                    rows.append((_number(head["warc-record-id"]), n, digest, head["warc-type"], _number(head.get("warc-refers-to")), head.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), names.values(), strict=True)], names=list(names))

    return indexed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, normalise them, read them back: one row a page.

    Null html is an empty payload; empty payloads are responses. A null url has no URI field, control characters in one are
    percent-encoded. A page without page_id is a response with null page_id. Rows with the same page_id and payload are
    each written, with the same type. Other columns are not read. An empty table gives no rows."""
    archives = materialise(write_archives(pages), "warc-whole")
    return read_records(materialise(normalise(archives), "warc-members")).drop("url")
