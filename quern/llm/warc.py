"""WARC archives: a writer, and a sequential reader.

An archive is a file in the shared folder, with one gzip member per record.
Each task writes its rows to archives of about ``archive_bytes``, whose names
hold the partition and the attempt. Only a manifest, one row per archive, goes
through Spark, and it says which files count: a task that runs twice leaves
files that no manifest names, and never mixes its records with those of the
first attempt.

The reader takes one archive per task and holds a chunk at a time, however long
a record is: it feeds a zlib decompressor, starts a new one at the end of each
member, splits the headers off, cuts the block by Content-Length, and compares
the SHA-1 of what passes by with the digest that the headers give.

Equal payloads are stored once: the page with the smallest id is a response,
others are revisit records with the digest and the response's id. Ids are
compared as numbers; rows that share the smallest id are all responses; a row
without id revisits unless no row of its payload has one. A null or empty html
is an empty payload; an empty table makes no archive; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, new_folder, table

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
#: Headers of over this many bytes are damaged.
MAX_HEAD = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, kind: str, refers_to) -> bytes:
    """One record, not yet compressed."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    head += [("WARC-Payload-Digest", f"sha1:{b32_sha1(payload)}"), ("X-Payload-Length", str(len(payload)))]
    http = HTTP % len(payload)
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
        block = http
    else:
        block = http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Damaged(ValueError):
    """An archive that can't be read to its end as it was written."""


def member_parts(stream, chunk: int = CHUNK):
    """Yield (bytes, last) for the content of the gzip members of a binary stream, at most ``chunk`` bytes at a time."""
    data = b""
    while data := data or stream.read(chunk):
        z = zlib.decompressobj(31)
        while not z.eof:
            data = data or stream.read(chunk)
            if not data:
                raise Damaged("the last member is cut off")
            try:
                part = z.decompress(data, chunk)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            data = z.unused_data if z.eof else z.unconsumed_tail
            yield part, z.eof


class Record:
    """A record that is read part by part; fails if lengths or digest disagree."""

    def __init__(self):
        self.pending, self.sha1 = b"", hashlib.sha1()
        self.head: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.left = self.payload_bytes = 0

    def _headers(self, what: str) -> tuple[str, dict[str, str]] | None:
        head, end, rest = self.pending.partition(b"\r\n\r\n")
        if not end:
            if len(head) > MAX_HEAD:
                raise Damaged(f"{what} headers without an end")
            return None
        self.pending = rest
        first, *lines = head.decode("utf-8").split("\r\n")
        pairs = (x.partition(":") for x in lines)
        self.left -= len(head) + 4
        return first, {k.strip().lower(): v.strip() for k, _, v in pairs}

    def feed(self, part: bytes) -> None:
        self.pending += part
        if self.head is None:
            if (found := self._headers("record")) is None:
                return
            first, self.head = found
            if not first.startswith("WARC/1."):
                raise Damaged("not a record")
            self.left = int(self.head["content-length"])
        if self.http is None:
            if (found := self._headers("HTTP")) is None:
                return
            self.http = found[1]
        own = self.pending[: max(self.left, 0)]
        self.sha1.update(own)
        self.payload_bytes += len(own)
        self.left -= len(own)
        self.pending = self.pending[len(own) :]

    def close(self) -> dict[str, str]:
        """The headers, once the last part has been fed."""
        if self.http is None or self.left != 0 or self.pending != b"\r\n\r\n":
            raise Damaged("a record isn't as long as it says")
        if self.head["warc-type"] == "response":
            digest = base64.b32encode(self.sha1.digest()).decode()
            if self.payload_bytes != int(self.http["content-length"]) or self.head["warc-payload-digest"] != f"sha1:{digest}":
                raise Damaged("a payload doesn't fit its length or digest")
        return self.head


def records(stream, chunk: int = CHUNK):
    """Yield (headers, payload bytes) of each record of an archive."""
    record = Record()
    for part, last in member_parts(stream, chunk):
        record.feed(part)
        if last:
            yield record.close(), record.payload_bytes
            record = Record()


def _page(urn: str | None):
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _local(uri: str) -> str:
    return uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, record_type, refers_to); the manifest, one row per archive."""

    def write(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done, out, n, size, name = 0, None, 0, 0, ""

        def close():
            nonlocal out, n, size, done
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [posixpath.join(folder, posixpath.basename(name))], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            out, n, size, done = None, 0, 0, done + 1
            return row

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = posixpath.join(base, f"part-{part:05d}-{attempt}-{done:04d}.warc.gz")
                    out = fs.open_output_stream(name, compression=None)
                payload = (row["html"] or "").encode()
                member = gzip_member(record_bytes(row["page_id"], row["url"], payload, row["record_type"], row["refers_to"]))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return records.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives named in ``path``; one archive is one row of input."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _open(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for head, payload_bytes in records(stream):
                        revisit = head["warc-type"] == "revisit"
                        rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), int(head["x-payload-length"]) if revisit else payload_bytes, head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], _page(head.get("warc-refers-to"))))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return manifest.select("path").mapInArrow(read, RECORD)


def record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, record_type and refers_to of each page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    first = rows.groupBy(digest.alias("__digest")).agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    first = materialize(first.drop("__n"), "first")
    typed = rows.join(first, digest == F.col("__digest"), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return typed.select("page_id", "url", "html", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder and read these."""
    spark = pages.sparkSession
    folder = _local(new_folder(spark, "warc"))
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = materialize(write_archives(record_types(pages), folder, archive_bytes), "manifest")
    n = max(manifest.count(), 1)
    return read_archives(manifest.repartition(min(n, 10_000)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
