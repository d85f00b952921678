"""WARC records as a table of chunks, written and read as streams.

A payload comes to its task whole, as one cell of the table of pages; from there on
records go in chunks, and no task holds a whole record again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import own_rows, table

CHUNK = 64 << 10
#: Fixed value: the profile of revisits of an equal payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = "record_id string, chunk_no int, data binary, digest_so_far string"
_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, verified boolean"


def bare_digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def payload_chunks(payload: memoryview, size: int = CHUNK) -> Iterator[memoryview]:
    for at in range(0, len(payload), size):
        yield payload[at : at + size]


def record_urn(page_id: int | None, row: int) -> str:
    """An identifier of the record of one row of pages."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{row}").urn


def record_chunks(
    page_id: int | None, row: int, url: str | None, payload: memoryview, refers_to: tuple[int | None, int] | None, size: int = CHUNK, date: str = "1970-01-01T00:00:00Z"
) -> Iterator[tuple[int, bytes, str]]:
    """(chunk number, bytes, digest of the payload up to there); joined in order they are one WARC/1.1 record.

    Chunk 0 is the header and, of a response, that of the HTTP message. A revisit, which
    refers to the page and row of a response, carries the digest and length of the
    payload it leaves out.
    """
    sha1 = hashlib.sha1()
    for part in payload_chunks(payload, size):
        sha1.update(part)
    http = b"" if refers_to else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_urn(page_id, row)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{bare_digest(sha1)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {0 if refers_to else len(http) + len(payload)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{record_urn(*refers_to)}>", *([f"X-Refers-To-Page-ID: {refers_to[0]}"] if refers_to[0] is not None else [])]
    yield 0, ("\r\n".join(lines) + "\r\n\r\n").encode() + http, ""
    so_far, no = hashlib.sha1(), 0
    for part in () if refers_to else payload_chunks(payload, size):
        so_far.update(part)
        no += 1
        yield no, bytes(part), bare_digest(so_far)
    yield no + 1, b"\r\n\r\n", bare_digest(so_far)


def _batch(chunks: list[tuple[str, int, bytes, str]]) -> pa.RecordBatch:
    types = {"record_id": pa.string(), "chunk_no": pa.int32(), "data": pa.binary(), "digest_so_far": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks, strict=True), types.values(), strict=True)], names=list(types))


def _write(size: int, date: str, at_once: int = 16 << 20):
    def run(batches):
        out, held = [], 0
        for batch in batches:
            ids, own, urls, html, pages, keepers = (batch.column(k) for k in range(6))
            for k in range(len(batch)):
                cell = html[k]
                payload = memoryview(cell.as_buffer()) if cell.is_valid else memoryview(b"")
                page, row, keeper = ids[k].as_py(), own[k].as_py(), keepers[k].as_py()
                urn = record_urn(page, row)
                for no, data, digest in record_chunks(page, row, urls[k].as_py(), payload, None if keeper is None else (pages[k].as_py(), keeper), size, date):
                    out.append((urn, no, data, digest))
                    held += len(data)
                    if held >= at_once:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return run


class RecordReader:
    """Reads the chunks of records in order; holds a header and a digest, never a payload."""

    def __init__(self) -> None:
        self.record = None

    def feed(self, record: str, no: int, data: memoryview, digest: str) -> tuple | None:
        """The record's row, once its closing chunk has come."""
        if no == 0:
            lines, http = bytes(data).split(b"\r\n\r\n", 1)
            head = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:] if ": " in line)
            self.record, self.head, self.sha1, self.left, self.sound = record, head, hashlib.sha1(), int(head["Content-Length"]) - len(http), True
            return None
        if record != self.record:
            raise ValueError(f"chunk {no} of {record} has no header before it")
        if self.left:
            self.sha1.update(data)
            self.left -= len(data)
            self.sound &= bare_digest(self.sha1) == digest
            return None
        head, revisit = self.head, self.head["WARC-Type"] == "revisit"
        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda key: int(head[key]) if key in head else None
        sound = self.sound and bytes(data) == b"\r\n\r\n" and (revisit or bare_digest(self.sha1) == said)
        return number("X-Page-ID"), int(head["X-Payload-Length"]), said, head["WARC-Type"], number("X-Refers-To-Page-ID"), sound


def _read(batches):
    reader = RecordReader()
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        out = []
        for record, no, data, digest in zip(*(batch.column(k) for k in range(4)), strict=True):
            row = reader.feed(record.as_py(), no.as_py(), memoryview(data.as_buffer()), digest.as_py())
            if row:
                out.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def write_archive(pages: DataFrame, chunk: int = CHUNK, least: int = 0, date: str | None = None) -> DataFrame:
    """The chunk table (record_id, chunk_no, data, digest_so_far) of pages, as written and read again.

    Of pages with equal payloads of at least least bytes the one with the largest
    page_id, the first of several, is a response and the others revisit it. A null html
    is an empty payload, a null url an empty one. Each row is a record, also where a
    page_id is repeated or null; null is smaller than every page_id. Records bear date,
    the time of writing if None. Other columns are ignored; an empty table gives an
    empty archive.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = own_rows(pages, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), key="page_id")
    full = full.withColumns({"n": F.octet_length("payload"), "sha": F.sha2("payload", 256)})
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.col("row")).alias("first"))
    keepers = full.where(F.col("n") >= least).groupBy("sha").agg(F.max(order).alias("k"), F.count("*").alias("c")).where("c > 1")
    keepers = staged(keepers.select("sha", F.col("k.page_id").alias("keeper"), (-F.col("k.first")).alias("keeper_row")), "payloads")
    other = F.col("keeper_row") != F.col("row")
    records = full.join(keepers, "sha", "left").select("page_id", "row", "url", "payload", F.when(other, F.col("keeper")).alias("keeper"), F.when(other, F.col("keeper_row")).alias("keeper_row"))
    return staged(records.mapInArrow(_write(chunk, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")), _CHUNKS), "warc")


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, digests checked chunk by chunk (verified)."""
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(_read, _RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages")))
