"""WARC archives as a table of chunks.

A record is a run of rows (record id, chunk number, number of chunks, bytes): the bytes of a record's chunks, in order, are
its WARC 1.1 text, and those of all records are an archive. A payload of any size is cut into chunks of CHUNK bytes while an
incremental SHA-256 runs over it, so that no copy of a whole record is ever made; each row carries the digest of the payload
up to its end. A reader takes a record of one chunk where it lies; the chunks of larger ones are dealt by record id, sorted by
chunk number and read one after the other, again with a running digest, which must equal each row's and the header's.

Of records with equal payloads of at least REVISIT bytes that with the least id is a response, the others are revisits that
refer to it. Defined cases: a null payload is empty; a repeated row of the response's id is a response too; a row without an
id is a response unless the payload has one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch

CHUNK = 256 << 10
REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no int, n_chunks int, data binary, payload_sha256 string"
_CHUNKS = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("data", pa.binary()), ("payload_sha256", pa.string())])


def _urn(page: int | None, digest: str) -> str:
    """Rows of one id and payload share a record id; rows of one id and other payloads do not."""
    return f"<urn:page:{'' if page is None else page}:{digest[:32]}>"


def _head(page: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """All of a record before its payload. A revisit's block is the HTTP header alone, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c for c in url or "" if c >= " ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def record_chunks(page: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS for one record."""
    body = payload if refers_to is None else payload[:0]
    n, running, name = max(1, -(-len(body) // chunk)), hashlib.sha256(), _urn(page, digest)
    for k in range(n):
        part = body[k * chunk : (k + 1) * chunk]
        running.update(part)
        pieces = [part]
        if k == 0:
            pieces.insert(0, _head(page, url, len(payload), digest, refers_to))
        if k == n - 1:
            pieces.append(b"\r\n\r\n")
        yield name, k, n, b"".join(pieces), running.hexdigest()


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> None:
    """Writes one WARC record for each row, as a table of chunks in Parquet."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = rows.where(F.octet_length("payload") >= REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(equal, "digest", "left").select("page", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i in range(b.num_rows):
                payload = memoryview(b.column(2)[i].as_buffer())
                for row in record_chunks(b.column(0)[i].as_py(), b.column(1)[i].as_py(), payload, b.column(3)[i].as_py(), b.column(4)[i].as_py(), chunk):
                    out.append(row)
                    size += len(row[3])
                    if size >= 4 << 20:
                        yield as_batch(_CHUNKS, *zip(*out, strict=True))
                        out, size = [], 0
            if out:
                yield as_batch(_CHUNKS, *zip(*out, strict=True))

    rows.mapInArrow(run, CHUNKS).write.parquet(path)


class RecordReader:
    """Reads one record chunk by chunk: header lines first, then a running digest over the payload."""

    def __init__(self):
        self.digest, self.size = hashlib.sha256(), 0

    @staticmethod
    def _heads(data: memoryview) -> tuple[bytes, int, int]:
        """The beginning of a record up to its payload, of any length, and where its two headers end."""
        size = 64 << 10
        while True:
            raw = bytes(data[:size])
            cut = raw.find(b"\r\n\r\n")
            end = raw.find(b"\r\n\r\n", cut + 4) if cut >= 0 else -1
            if end >= 0:
                return raw, cut, end
            if size >= len(data):
                raise ValueError("a record's header does not end")
            size *= 4

    def feed(self, data: memoryview, first: bool, last: bool, expected: str) -> None:
        if first:
            raw, cut, http_end = self._heads(data)
            lines = raw[:cut].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.http = dict(x.split(": ", 1) for x in raw[cut + 4 : http_end].decode().split("\r\n")[1:])
            self.block = int(self.head["Content-Length"]) - (http_end - cut)
            data = data[http_end + 4 :]
        if last:
            if data[-4:] != b"\r\n\r\n":
                raise ValueError("a record's end is missing")
            data = data[:-4]
        self.digest.update(data)
        self.size += len(data)
        if self.digest.hexdigest() != expected:
            raise ValueError(f"{self.head.get('WARC-Record-ID')}: a chunk's payload digest does not match")

    def row(self) -> tuple:
        page = lambda urn: int(x) if (x := urn.split(":")[2]) else None
        if self.size != self.block:
            raise ValueError("a record's length does not match")
        digest, kind = self.head["WARC-Payload-Digest"].removeprefix("sha256:"), self.head["WARC-Type"]
        if kind == "response" and self.digest.hexdigest() != digest:
            raise ValueError("a payload's digest does not match its header")
        return page(self.head["WARC-Record-ID"]), int(self.http["Content-Length"]), digest, kind, page(self.head["WARC-Refers-To"]) if kind == "revisit" else None


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, due = None, 0
    for b in batches:
        out = []
        for i in range(b.num_rows):
            k, n = b.column(1)[i].as_py(), b.column(2)[i].as_py()
            if k == 0:
                reader, due = RecordReader(), 0
            if k != due:
                raise ValueError("a record's chunk is missing")
            reader.feed(memoryview(b.column(3)[i].as_buffer()), k == 0, k == n - 1, b.column(4)[i].as_py())
            due = k + 1
            if k == n - 1:
                out.append(reader.row())
        if out:
            yield as_batch(_RECORDS, *zip(*out, strict=True))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reads every record back; see RECORDS."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    one = chunks.where("n_chunks = 1").mapInArrow(_read, RECORDS)
    # several records of one id: equal payloads are equal chunk for chunk, so whole copies are told apart by a copy number
    many = chunks.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "n_chunks", "chunk_no", "payload_sha256").mapInArrow(_read_many, RECORDS)
    return one.unionByName(many)


def _read_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by record id and chunk number: repeated rows' equal chunks lie side by side and are read in step."""
    reader, at, copies, seen = None, None, 0, 0
    for b in batches:
        out = []
        for i in range(b.num_rows):
            key, k, n = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()
            if (key, n, k) == at:
                seen += 1
                if k == n - 1:
                    out.append(reader.row())
                continue
            if k == 0:
                reader, copies = RecordReader(), 0
            elif at != (key, n, k - 1) or copies and seen != copies:
                raise ValueError("a record's chunk is missing")
            copies, seen, at = seen if k else 0, 1, (key, n, k)
            reader.feed(memoryview(b.column(3)[i].as_buffer()), k == 0, k == n - 1, b.column(4)[i].as_py())
            if k == n - 1:
                out.append(reader.row())
        if out:
            yield as_batch(_RECORDS, *zip(*out, strict=True))


def export_warc(spark: SparkSession, path: str, target: str) -> int:
    """Writes the archive as one plain .warc file for other tools, chunk by chunk; returns its bytes."""
    size = 0
    with open(target, "wb") as f:
        for row in spark.read.schema(CHUNKS).parquet(path).select("record_id", "chunk_no", "data", "payload_sha256").sort("record_id", "chunk_no", "payload_sha256").toLocalIterator():
            size += f.write(row["data"])
    return size
