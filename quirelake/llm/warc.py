"""Operator 3: WARC archives through a chunked record table.

Writing: each task streams its rows into one gzip-per-record WARC/1.1 file in
the shared folder; payloads pass through in chunks of CHUNK bytes, and digests
are updated chunk by chunk. Of records with equal payloads one is a response,
the others are revisit records that refer to it and hold no payload.

Reading: each task streams an archive and yields rows (record identifier,
chunk number, chunk, bytes so far, SHA-1 so far); no record is held whole, and
the row of the last chunk carries the digest of the whole payload. So record
totals come from one filter, without a shuffle.

A file's name holds its partition and a fresh identifier, and the manifest
lists only files of tasks that ended well: a task that is run again (a lost
executor) leaves an orphan that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, sized, small_batches, written

CHUNK = 64 * 1024
#: Level of gzip members.
LEVEL = 6
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CHUNKS = "page_id long, record_id string, record_type string, refers_to long, target_uri string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(page_id: int | None, uri: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{uri}')}>"


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _clean(uri: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else f"urn:page:{page_id}"


def _pieces(head: bytes, payload: memoryview | None, http: bytes):
    yield head
    if payload is not None:
        yield http
        for at in range(0, len(payload), CHUNK):
            yield payload[at : at + CHUNK]
    yield b"\r\n\r\n"


def _writer(folder: str):
    """Arrow batches (page_id, url, payload, refers_to, revisit) -> a row per archive."""

    def run(batches):
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records, size = None, 0, 0
        for batch in batches:
            ids, urls, revisits, refers = (batch.column(k).to_pylist() for k in ("page_id", "url", "revisit", "refers_to"))
            payloads = batch.column("payload")
            for i, page in enumerate(ids):
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}")
                payload = memoryview(payloads[i].as_buffer())
                sha = hashlib.sha1()
                for at in range(0, len(payload), CHUNK):
                    sha.update(payload[at : at + CHUNK])
                digest, uri = base32_sha1(sha.digest()), _clean(urls[i], page)
                http = _HTTP % len(payload)
                lines = [
                    "WARC/1.1",
                    f"WARC-Type: {'revisit' if revisits[i] else 'response'}",
                    f"WARC-Record-ID: {record_id(page, f'{uri}|{name}|{records}')}",
                    f"WARC-Target-URI: {uri}",
                    "WARC-Date: 1970-01-01T00:00:00Z",
                    f"WARC-Payload-Digest: sha1:{digest}",
                    "Content-Type: application/http; msgtype=response",
                    f"Content-Length: {0 if revisits[i] else len(http) + len(payload)}",
                    f"X-Payload-Length: {len(payload)}",
                ]
                lines += [] if page is None else [f"X-Page-ID: {page}"]
                if revisits[i]:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers[i]}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z"]
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for piece in _pieces(("\r\n".join(lines) + "\r\n\r\n").encode(), None if revisits[i] else payload, http):
                    size += out.write(squeeze.compress(piece)) or 0
                out.write(squeeze.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

    return run


class _Members:
    """The bytes of concatenated gzip members, one stream, read by need."""

    def __init__(self, stream):
        self.stream, self.raw, self.buffer, self.inflate, self.over = stream, b"", bytearray(), None, False

    def _more(self) -> bool:
        while not self.over:
            if self.inflate is None or self.inflate.eof:
                self.raw = (self.inflate.unused_data if self.inflate else self.raw) or self.stream.read(CHUNK)
                if not self.raw:
                    self.over = True
                    return False
                self.inflate = zlib.decompressobj(31)
            elif not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise EOFError("archive ends inside a member")
            got = self.inflate.decompress(self.raw, CHUNK)
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the archive."""
        start = 0
        while (at := self.buffer.find(b"\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one."""
        if not self.buffer and not self._more():
            raise EOFError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        return out


def read_archive(stream, with_chunks: bool = True):
    """Chunk rows of one archive, as tuples in the order of _CHUNKS."""
    data = _Members(stream)
    while True:
        first = data.line()
        while first == b"":
            first = data.line()
        if first is None:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {}
        while line := data.line():
            key, _, value = line.decode("utf-8").partition(": ")
            head[key.lower()] = value
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind not in ("response", "revisit"):  # another writer's records: their blocks are passed over
            while left:
                left -= len(data.take(min(left, CHUNK)))
            continue
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        refers = int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None
        same = (page, head["warc-record-id"], kind, refers, head.get("warc-target-uri"))
        if kind == "revisit":  # the digest and length of the full payload stand in the head
            while left:
                left -= len(data.take(min(left, CHUNK)))
            yield (*same, 0, b"" if with_chunks else None, int(head["x-payload-length"]) if "x-payload-length" in head else None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, True)
            continue
        while line := data.line():  # the HTTP head
            left -= len(line) + 2
        left -= 2
        sha, done, no, full = hashlib.sha1(), 0, 0, left
        while True:
            parts = []
            size = 0
            while left and size < CHUNK:
                part = data.take(min(left, CHUNK - size))
                sha.update(part)
                parts.append(part)
                size += len(part)
                left -= len(part)
            done += size
            digest = base32_sha1(sha.digest())
            if done == full and head.get("warc-payload-digest", "").startswith("sha1:") and f"sha1:{digest}" != head["warc-payload-digest"]:
                raise ValueError(f"payload of {same[1]} doesn't match its digest")
            yield (*same, no, b"".join(parts) if with_chunks else None, done, digest, done == full)
            no += 1
            if done == full:
                break


def _reader(folder: str, with_chunks: bool, names: list[str]):
    def run(batches):
        system, root = _file_system(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{root}/{name}") as stream:
                    for row in read_archive(stream, with_chunks):
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size > 1 << 21:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=_ARROW)

    return run


_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> manifest (archive, records, bytes), written to folder too.

    Of equal payloads of at least least_bytes bytes the record with the largest
    page_id is the response. A null html is an empty payload, a null url gives
    the target urn:page:<page_id>. Rows without a page_id are responses unless
    a record with a page_id has the same payload; of repeated rows with the
    largest page_id each is a response. An empty table gives no archive."""
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    equal = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    equal = written(spark, equal, "equal-payloads")
    # marks are found on narrow rows and met by page, so a common payload is no hot key of wide ones
    marks = rows.select("page_id", "digest").join(sized(equal), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    marks = written(spark, marks.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first"), "revisits")
    typed = rows.join(sized(marks), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").withColumn("revisit", F.col("first").isNotNull())
    parts = typed.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit").mapInArrow(_writer(folder), "archive string, records long, bytes long")
    parts.write.parquet(f"{folder}/manifest")
    return spark.read.schema(parts.schema).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_chunks: bool = True) -> DataFrame:
    """The chunk table of the archives that the manifest lists."""
    n = max(1, manifest.count())
    one_each = manifest.select("archive").repartitionByRange(n, "archive")
    return one_each.mapInArrow(_reader(folder, with_chunks, _ARROW.names), _CHUNKS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(spark, read(spark, sf_dir, "pages"), folder, least_bytes=0)
    chunks = read_archives(spark, manifest, folder, with_chunks=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, html, sha1(html) AS h FROM p),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT d.page_id, d.n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(d.h, 1 + 5 * (i // 4), 5))::INTEGER >> (5 * (3 - i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d JOIN f USING (html)
"""
