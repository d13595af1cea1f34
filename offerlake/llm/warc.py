"""WARC archives written from a page table and read back as a chunked record table.

Writing: a payload is cut into rows (record, chunk number, bytes) by DataFrame
functions; a task streams its rows, one after the other, into a gzip member
per record and checks the payload's SHA-1, which it carries along, at the
last chunk.  Of pages with equal payloads the one with the largest page_id is
a response record, the others are revisit records without payload that refer
to it.  Each task writes one archive under a temporary name and renames it,
so a repeated task replaces its own file; a manifest table lists the archives.

Reading: a task streams an archive and returns rows (record, chunk number,
bytes, bytes so far, digest so far); no side ever holds a whole record beyond
the cell of the page table.  The last row of a record has the digest of all.

Archives are opened with ``pyarrow.fs``, by the URI of the shared folder.

Defined cases: null html is the empty payload; a null page_id comes after all
others and its records carry no page id; rows that repeat a response's page_id
and payload are responses, too; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.session import saved, scratch_path

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("chunk_no", T.LongType()),
    T.StructField("last", T.BooleanType()), T.StructField("data", T.BinaryType()),
    T.StructField("bytes_so_far", T.LongType()), T.StructField("digest_so_far", T.StringType()),
])


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id, digest: str, place: str | None) -> str:
    name = f"{'' if page_id is None else page_id}/{digest}" + (f"/{place}" if place else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _head(kind: str, record_id: str, length: int, fields: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"Content-Length: {length}",
             *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


class _Archive:
    """One archive being written: a gzip member per record, payloads chunk by chunk."""

    def __init__(self, stream, place: str, date: str):
        self.stream, self.place, self.date, self.records = stream, place, date, 0
        self.member = None
        self._open(_head("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", 0,
                         {"WARC-Date": date, "Content-Type": "application/warc-fields"}))
        self._close()

    def _open(self, head: bytes):
        self.member = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.stream.write(self.member.compress(head))

    def _close(self):
        self.stream.write(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def add(self, row: dict):
        """The next chunk of a record; chunk 0 begins it."""
        digest = _base32(bytes.fromhex(row["sha1"]))
        revisit = row["record_type"] == "revisit"
        if row["chunk_no"] == 0:
            http = _http(row["payload_bytes"])
            refers = _record_id(row["refers_to"], digest, None) if revisit else None
            own = _record_id(row["page_id"], digest, f"{self.place}/{self.records}" if revisit else None)
            url = None if row["url"] is None else " ".join(row["url"].split())
            self._open(_head(row["record_type"], own, len(http) + (0 if revisit else row["payload_bytes"]), {
                "WARC-Date": self.date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}",
                "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": refers,
                "X-Page-ID": row["page_id"], "X-Refers-To-Page-ID": row["refers_to"] if revisit else None,
                "Content-Type": "application/http;msgtype=response"}) + http)
            self.sha1 = hashlib.sha1()
        if not revisit:
            self.sha1.update(row["data"])
            self.stream.write(self.member.compress(row["data"]))
        if row["last"]:
            if not revisit and self.sha1.hexdigest() != row["sha1"]:
                raise ValueError(f"page {row['page_id']}: the chunks aren't the payload of digest {row['sha1']}")
            self._close()
            self.records += 1


def _payload_chunks(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """Pages as chunk rows, each record's rows together and in order; revisits have one row without data."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("raw")).withColumn(
        "digest", F.unhex(F.sha2("raw", 256)))
    groups = saved(keyed.groupBy("digest").agg(F.max("page_id").alias("first_id")), "warc-groups")
    typed = keyed.join(groups, "digest").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first_id")))
    n = F.when(F.col("is_first"), F.greatest(F.ceil(F.length("raw") / chunk_bytes), F.lit(1))).otherwise(1)
    chunk = F.expr(f"substring(raw, cast(chunk_no * {chunk_bytes} + 1 as int), {chunk_bytes})")
    rows = typed.select(
        "page_id", "url", "raw", F.sha1("raw").alias("sha1"), F.length("raw").cast("long").alias("payload_bytes"),
        F.when(F.col("is_first"), "response").otherwise("revisit").alias("record_type"),
        F.when(~F.col("is_first"), F.col("first_id")).alias("refers_to"), n.cast("long").alias("n_chunks"),
        F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_no"))
    return rows.select("page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to", "chunk_no",
                       (F.col("chunk_no") == F.col("n_chunks") - 1).alias("last"),
                       F.when(F.col("record_type") == "response", chunk).alias("data"))


def write_warc(pages: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under the URI ``folder``; the manifest (path, records)."""

    def write(batches):
        context = TaskContext.get()
        place = f"part-{context.partitionId():06d}"
        archive = stream = None
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(c) for c in names)):
                if archive is None:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    path = posixpath.join(root, f"{place}.warc.gz")
                    temporary = posixpath.join(root, f".{place}-{context.taskAttemptId()}.tmp")
                    stream = fs.open_output_stream(temporary, compression=None)
                    archive = _Archive(stream, place, date)
                archive.add({c: v.as_py() for c, v in zip(names, values)})
        if archive is not None:
            stream.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{place}.warc.gz"]), pa.array([archive.records], pa.int64())],
                                             names=["path", "records"])

    return saved(_payload_chunks(pages, chunk_bytes).mapInArrow(write, "path string, records long"), "warc-manifest")


def _records(stream, chunk_bytes: int, with_data: bool):
    """Chunk rows of one archive, as tuples in the order of CHUNKS."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _fields(stream)
        kind, left = head["warc-type"], int(head["content-length"])
        if kind in ("response", "revisit"):
            http_bytes, http = _status(stream)
            left -= http_bytes
            page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
            base = (head["warc-record-id"], page and int(page), head.get("warc-target-uri"), kind, refers and int(refers))
            told = head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "revisit":
                yield *base, 0, True, None, int(http["content-length"]), told
            else:
                sha1, done, number = hashlib.sha1(), 0, 0
                while True:
                    data = stream.read(min(left, chunk_bytes))
                    sha1.update(data)
                    left, done = left - len(data), done + len(data)
                    digest = _base32(sha1.digest())
                    if (left == 0 or not data) and digest != told:
                        raise ValueError(f"{base[0]}: payload digest {digest}, the header has {told}")
                    yield *base, number, left == 0, data if with_data else None, done, digest
                    number += 1
                    if left == 0:
                        break
        while left > 0:
            left -= len(stream.read(min(left, chunk_bytes)))
        stream.read(4)


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _status(stream) -> tuple[int, dict[str, str]]:
    """Length and fields of the HTTP head of a block."""
    size, out = 0, {}
    while line := stream.readline():
        size += len(line)
        if line == b"\r\n":
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return size, out


def read_chunks(manifest: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The archives' records as chunk rows; an archive is read by one task, chunk by chunk."""
    schema = T.StructType([f for f in CHUNKS if with_data or f.name != "data"])
    keep = [i for i, f in enumerate(CHUNKS) if with_data or f.name != "data"]
    arrow = pa.schema([(f.name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[
        f.dataType.typeName()]) for f in schema])

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows, size = [], 0
                    for row in _records(stream, chunk_bytes, with_data):
                        rows.append([row[i] for i in keep])
                        size += 256 + len(row[7] or b"")
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    files = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(read, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: every page written to WARC archives, and what they hold when read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_warc(pages, scratch_path(spark, "warc"))
    return read_chunks(manifest, with_data=False).filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
        "record_type", "refers_to")


# five hexadecimal digits of the SHA-1 are four digits to the base 32
_QUAD = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {k}) & 31 AS INT) + 1, 1)" for k in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS raw, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(strlen(raw) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform([CAST('0x' || substr(sha1(raw), 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)], lambda v: {_QUAD}), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p
"""
