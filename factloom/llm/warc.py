"""WARC records as a chunked table.

A record is one row or more of at most CHUNK payload bytes: record_no, chunk_no, the bytes as they stand in a WARC file
(chunk 0 begins with the record's header and HTTP header, the last one ends with the closing line ends), and the SHA-1
of the payload up to there. So an oversized payload is written and read as a stream of chunks, each held against its
running digest, and no record is ever put together in memory. Concatenated by record and chunk, the data are WARC 1.1.

Of records with equal payloads of at least min_revisit bytes the one with the smallest page_id is a response, the others
are revisits that refer to it and leave the payload out. Null html is an empty payload. A null page_id is always a
response and is referred to by none. Rows repeated under the smallest page_id are all responses. Null urls are left out
of the header, control characters in urls are percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Tables of at most this many revisits (64 bytes each) are broadcast.
FEW_REVISITS = 500_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
SCHEMA = "record_no long, page_id long, chunk_no long, last boolean, data binary, running string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(HTTP) + (n_bytes if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + END + HTTP


def records(pages: DataFrame, min_revisit: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    keys = rows.select("page_id", "sha1").filter((F.octet_length("payload") >= min_revisit) & F.col("page_id").isNotNull())
    first = keys.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    if first.count() <= FEW_REVISITS:  # else a frequent payload is split by Spark where it is skewed
        first = F.broadcast(first)
    revisits = keys.join(first, "sha1").filter("page_id <> refers_to").distinct()
    if revisits.count() <= FEW_REVISITS:
        revisits = F.broadcast(revisits)

    def run(batches):
        n = TaskContext.get().partitionId() << 40
        out, held = [], 0

        def batch_of(out):
            cols = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()))], ["record_no", "page_id", "chunk_no", "last", "data", "running"])

        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for page_id, url, scalar, sha1, refers_to in zip(ids, urls, batch.column(2), batch.column(3).to_pylist(), refers):
                data = memoryview(scalar.as_buffer())  # a view on the batch, no copy of the payload
                digest = base32(bytes.fromhex(sha1))
                size, running = len(data), hashlib.sha1()
                lead = header(page_id, url, digest, size, refers_to)
                if refers_to is not None:
                    out.append((n, page_id, 0, True, lead + END, base32(running.digest())))
                    held += len(lead)
                else:
                    for k, at in enumerate(range(0, max(size, 1), chunk)):
                        part, last = data[at : at + chunk], at + chunk >= size
                        running.update(part)
                        out.append((n, page_id, k, last, b"".join((lead if k == 0 else b"", part, END if last else b"")), base32(running.digest())))
                        held += len(part) + 64
                        if held > 8 << 20:
                            yield batch_of(out)
                            out, held = [], 0
                n += 1
            yield batch_of(out)
            out, held = [], 0

    joined = rows.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to")
    return joined.mapInArrow(run, SCHEMA)


class Reader:
    """Reads one record, chunk by chunk."""

    def __init__(self, first: bytes):
        head, self.rest = first.split(END, 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        self.kind, self.digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        self.page_id, self.refers_to = (None if x is None else int(x) for x in (page, refers))
        http, self.rest = self.rest.split(END, 1)
        self.left = int(fields["Content-Length"]) - len(http) - len(END)
        self.stated, self.size, self.sha1, self.good = int(fields["X-Payload-Length"]), 0, hashlib.sha1(), True

    def feed(self, data: bytes, running: str) -> None:
        part = memoryview(data)[: self.left]
        self.sha1.update(part)
        self.left -= len(part)
        self.size += len(part)
        self.good &= base32(self.sha1.digest()) == running

    def row(self) -> tuple:
        if self.kind == "revisit":  # size and digest of the full payload stand in the header
            return self.page_id, self.stated, self.digest, self.kind, self.refers_to, self.good and self.size == 0
        return self.page_id, self.size, base32(self.sha1.digest()), self.kind, self.refers_to, self.good and self.left == 0 and base32(self.sha1.digest()) == self.digest and self.size == self.stated


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in record and chunk order."""
    reader, number = None, None
    for batch in batches:
        out = []
        for no, chunk_no, last, data, running in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if chunk_no == 0:
                reader, number = Reader(data), no
                reader.feed(reader.rest, running)
            elif no == number:
                reader.feed(data, running)
            else:
                raise ValueError(f"chunk {chunk_no} of record {no} has none before it")
            if last:
                out.append(reader.row())
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])


def read(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of every record of a chunk table.

    Records of one row are read where they lie; only the chunks of longer ones are shuffled and sorted."""
    rows, schema = archive.select("record_no", "chunk_no", "last", "data", "running"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
    single = (F.col("chunk_no") == 0) & F.col("last")
    several = rows.filter(~single).repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    return rows.filter(single).mapInArrow(_read, schema).unionByName(several.mapInArrow(_read, schema))


#: The same facts in DuckDB; base32 of the SHA-1 by groups of five hex digits.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM p JOIN f USING (h)
"""
