"""WARC archives read through an index.

Writing: every task appends one gzip member per record to an archive of its own and returns one index
row per record (archive, offset, length, url, digest, ...); the index is written as Parquet. An archive
of a failed attempt is never named by the index. Reading: the selected index rows are sorted by
(archive, offset), neighbouring byte ranges are coalesced into one read, and records are parsed from it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, hold, scratch, small_batches

#: payloads under this are stored again rather than referred to
DEDUP_MIN_BYTES = 1000
#: one read spans at most this many bytes and skips gaps up to READ_GAP
READ_BYTES, READ_GAP = 4 << 20, 64 << 10
#: the table of repeated payloads is broadcast up to this size, joined by a shuffle beyond it
BROADCAST_BYTES = 32 << 20
REPEAT_ROW_BYTES = 96

INDEX_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
                "payload_bytes long, archive string, offset long, length long")
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, "
                 "record_type string, refers_to long, payload string")


def file_system(uri: str):
    """The pyarrow file system of a shared folder's URI and the path in it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame, payload: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least DEDUP_MIN_BYTES, the one with the largest page_id is the response
    and the rest are revisits of it. Repeated rows of that page_id are all responses; where every
    page_id of a payload is null they are responses too, and a null page_id beside others revisits.
    A null payload is empty.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.sha1(body.cast("binary")).alias("payload_digest"))
    # narrow: digests only, combined before the shuffle, so a payload of any number of copies is one row
    repeats = hold(rows.where(F.col("payload_bytes") >= DEDUP_MIN_BYTES).groupBy("payload_digest")
                     .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
                     .where("_n > 1 and _last is not null").select("payload_digest", "_last"))
    if repeats.count() * REPEAT_ROW_BYTES <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(repeats), "payload_digest", "left")
    else:
        joined = rows.join(repeats.hint("merge"), "payload_digest", "left")  # AQE splits a hot digest
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("_last")).alias("refers_to"))


def record(kind: str, page_id, url, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One WARC/1.1 record. Line ends in a URL would end the header, so they are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}",
             f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is None:
        lines.append("X-No-URL: 1")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch. Numbers stay whole beside nulls; as floats, ids above 2^53 would change."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)],
                                      names=[name for name, _ in fields])


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """A record's fields; the digest of a response is taken anew from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[:int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    number = lambda k: int(fields[k].rsplit(":", 1)[1][:-1]) if k in fields else None
    stored = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    whole = kind == "response"
    if whole and hashlib.sha1(payload).hexdigest() != stored:
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} doesn't have its digest")
    return {"page_id": number("WARC-Record-ID"), "url": None if "X-No-URL" in fields else fields["WARC-Target-URI"],
            "payload_bytes": len(payload) if whole else int(fields["X-Payload-Length"]), "payload_digest": stored,
            "record_type": kind, "refers_to": number("WARC-Refers-To"),
            "payload": payload.decode() if whole else None}


def write_archives(pages: DataFrame, folder: str | None = None, payload: str = "html") -> DataFrame:
    """Write every row as a record and return the index (written, then read back)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        task = TaskContext.get()
        name = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(name, compression=None)
            rows = []
            for page_id, url, body, size, digest, kind, last in zip(
                    *(batch.column(c).to_pylist() for c in
                      ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")),
                    strict=True):
                data = gzip_member(record(kind, page_id, url, digest, size, last, body.encode()))
                out.write(data)
                rows.append((page_id, url, kind, last, digest, size, name, at, len(data)))
                at += len(data)
            yield frame(rows, INDEX_SCHEMA)
        if out is not None:
            out.close()

    return freeze(classify(pages, payload).mapInArrow(write, INDEX_SCHEMA), "warc-index").withColumn(
        "folder", F.lit(folder))


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` rows select, as RECORD_SCHEMA.

    Ranges of one stretch of an archive meet in one task, sorted; neighbours are read at once.
    """
    small_batches(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream, store = None, None, None
        for batch in batches:
            rows, k, size = [], 0, 0
            places = list(zip(*(batch.column(c).to_pylist() for c in ("folder", "archive", "offset", "length")), strict=True))
            while k < len(places):
                folder, archive, start, length = places[k]
                end, j = start + length, k + 1
                while (j < len(places) and places[j][1] == archive and 0 <= places[j][2] - end <= READ_GAP
                       and places[j][2] + places[j][3] - start <= READ_BYTES):
                    end, j = places[j][2] + places[j][3], j + 1
                if opened != archive:
                    store = store or file_system(folder)[0]
                    stream, opened = store.open_input_file(archive), archive
                data = stream.read_at(end - start, start)
                for _, _, at, n in places[k:j]:
                    fields = parse(zlib.decompress(data[at - start:at - start + n], 31))
                    rows.append(tuple(fields[c.split()[0]] for c in RECORD_SCHEMA.split(", ")))
                    size += fields["payload_bytes"]
                k = j
                if size > READ_BYTES:
                    yield frame(rows, RECORD_SCHEMA)
                    rows, size = [], 0
            yield frame(rows, RECORD_SCHEMA)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * READ_BYTES)))
    stretch = F.floor(F.col("offset") / (4 * READ_BYTES))
    return (index.select("folder", "archive", "offset", "length").repartition(tasks, "archive", stretch)
            .sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD_SCHEMA))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, then read all records back: page_id, payload_bytes, payload_digest (bare hex
    SHA-1), record_type, refers_to, url. Other columns of ``pages`` are ignored; no rows, no archives."""
    return read_records(write_archives(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
