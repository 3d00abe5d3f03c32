"""WARC archives: writing them, making monolithic ones seekable, reading them back.

An archive is a row (archive, content) of a table, content the bytes of one .warc.gz file; spark.read.format("binaryFile")
gives the same shape for files that exist. The writer makes monolithic archives: one gzip stream over all records. The
normaliser inflates such a stream once, a block at a time, rewrites every record as a gzip member of its own and keeps
a sidecar index of offsets. Readers then take records one by one, or a single one by its offset.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Payloads below this many bytes are always kept whole; the payload bytes after which a new archive begins.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 8 << 20
BLOCK = 1 << 18
END = b"\r\n"


def classify(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null: a response). Null html is an empty payload.

    Of equal payloads of at least `least` bytes the largest page_id is the response and the others refer to it. Rows with
    the response's own id, or with no id at all in a group without ids, are responses too.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "payload_bytes", "first")
    )
    out = rows.join(groups, ["digest", "payload_bytes"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return out.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", refers.alias("refers_to"))


def _record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One uncompressed WARC record. A revisit has no payload, but its digest and length."""
    kind = b"response" if refers is None else b"revisit"
    body = payload if refers is None else b""
    head = [
        b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:page:%s>" % (b"" if page is None else b"%d" % page),
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(), b"WARC-Date: 2020-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size, b"Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers]
    head.append(b"Content-Length: %d" % len(body or b""))
    return END.join(head) + END + END + (body or b"") + END + END


def write_monolithic(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) from the rows of classify(): each archive is one gzip stream of about archive_bytes of payload."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, zip_, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                zip_ = zip_ or zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = _record(*row)
                held.append(zip_.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield _archive(part, n, b"".join([*held, zip_.flush()]))
                    n, zip_, held, size = n + 1, None, [], 0
        if zip_:
            yield _archive(part, n, b"".join([*held, zip_.flush()]))

    columns = pages.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
    return columns.mapInArrow(emit, "archive string, content binary")


def _archive(part: int, n: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:04d}.warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"])


def inflated(content: bytes) -> Iterator[bytes]:
    """The plain bytes of a gzip file, of one member or of many, in blocks; a member that is cut off raises."""
    whole, unzip = memoryview(content), None
    for lo in range(0, len(content), BLOCK):
        data = bytes(whole[lo : lo + BLOCK])
        while data:
            unzip = unzip or zlib.decompressobj(31)
            plain = unzip.decompress(data, 4 * BLOCK)
            data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if plain:
                yield plain
            if unzip.eof:
                unzip = None
            elif not data:
                while plain := unzip.decompress(b"", 4 * BLOCK):
                    yield plain
                if unzip.eof:
                    unzip = None
    if unzip:
        raise ValueError("the archive ends within a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records cut from a stream of plain WARC bytes; a record cut short at the end raises."""
    held = bytearray()
    for block in blocks:
        held += block
        at = 0
        while (end := held.find(END + END, at)) >= 0:
            size = next(int(x[15:]) for x in bytes(held[at:end]).split(END) if x[:15].lower() == b"content-length:")
            stop = end + 4 + size + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"the archive ends within a record: {len(held)} bytes are left")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, index): every record a gzip member of its own; index is an array of (offset, length, plain)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("plain", pa.int64())]))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members, index, at = [], [], 0
                for raw in records(inflated(content.as_py() or b"")):
                    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = zip_.compress(raw) + zip_.flush()
                    index.append({"offset": at, "length": len(member), "plain": len(raw)})
                    members.append(member)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    shape = "archive string, content binary, index array<struct<offset: bigint, length: bigint, plain: bigint>>"
    return archives.select(F.col("archive"), F.col("content")).mapInArrow(emit, shape)


def parse(raw: bytes) -> dict:
    """Of one plain record: its page, type, what it refers to, digest, payload length and payload (None for a revisit)."""
    head, _, rest = raw.partition(END + END)
    fields = dict(x.split(b": ", 1) for x in head.split(END)[1:])
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:page:7>
    revisit = fields[b"WARC-Type"] == b"revisit"
    payload = None if revisit else rest[: int(fields[b"Content-Length"])]
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields[b'WARC-Record-ID']!r} is damaged")
    return {
        "page_id": number(fields[b"WARC-Record-ID"]), "url": fields[b"WARC-Target-URI"].decode(), "record_type": "revisit" if revisit else "response",
        "refers_to": number(fields.get(b"WARC-Refers-To")), "payload_digest": digest, "payload_bytes": int(fields[b"X-Payload-Length"]), "payload": payload,
    }


READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read(normalised: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each read through the sidecar index as one member by itself."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content, index in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, rows = memoryview(content.as_py()), []
                for x in index:
                    row = parse(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31))
                    rows.append(row if with_payload else row | {"payload": None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return normalised.select("content", "index").mapInArrow(emit, READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    monolithic = stored(write_monolithic(classify(table(spark, sf_dir, "pages"))), "warc-whole")
    seekable = stored(normalise(monolithic), "warc-members")
    return read(seekable, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
    select *, max(page_id) over (partition by payload_digest, payload_bytes) as first from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and first <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and first <> page_id then first end as refers_to
from g
"""
