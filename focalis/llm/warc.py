"""WARC archives: a writer and a splittable reader (operator 9).

The writer makes one file a task, one gzip member a record. Of rows with equal payloads of at
least ``REVISIT_BYTES`` bytes, that with the smallest page id is a ``response``; the others are
``revisit`` records that name it and carry its payload's digest and length, not the payload.

The reader cuts files into byte ranges. A task looks in its range for the magic bytes of gzip,
takes a place as the start of a member if what it decodes to begins like a WARC record, and owns
the records whose members start inside its range, reading past its end for the last one. Where a
member does not decode, the search goes on one byte later.

Defined results: a null payload is empty; a null page id or URL comes back as null; a row
without an id is never the one that others refer to, but may refer; rows with the response's own
id and payload are responses too; payloads may be empty or of any length; no rows give no
records; columns other than id, URL and payload are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, fresh, written
from .words import slices

REVISIT_BYTES = 100
BROADCAST_GROUPS = 200_000
SPLIT_BYTES = 8 << 20
STEP = 1 << 18
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "<urn:page:%s>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OUT_BYTES = 4 << 20


def member(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A record as one gzip member. The same row always gives the same bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {RECORD_ID % ('' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$&()*+,/:;=?@[]~-._' + chr(39))}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {RECORD_ID % refers_to}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(record: bytes) -> dict | None:
    """The fields of a response or revisit record; None for other records."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))

    def number(name: str) -> int | None:
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {
        "page_id": number("WARC-Record-ID"),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "declared_bytes": size,
        "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Write ``pages``; returns the manifest (uri, bytes, records), itself written."""
    spark = pages.sparkSession
    folder = fresh(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("bytes", F.octet_length("text").cast("long"))
    first = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1 and first is not null").select("digest", "first"), "warc-copies")
    if first.count() <= BROADCAST_GROUPS:
        first = F.broadcast(first)
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "text", "digest", "bytes", F.when(copy, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():08d}.warc.gz"
        store, path = filesystem(uri)
        part, out, size, n = f"{path}.{TaskContext.get().taskAttemptId()}.tmp", None, 0, 0
        for batch in batches:
            for some in slices(batch):
                for page_id, link, text, digest, length, refers_to in zip(*(c.to_pylist() for c in some.columns)):
                    if out is None:
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(part)
                    data = member("response" if refers_to is None else "revisit", page_id, link, text.encode("utf-8", "surrogatepass"), digest, length, refers_to)
                    out.write(data)
                    size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            store.move(part, path)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return written(rows.mapInArrow(run, "uri string, bytes long, records long"), "warc-manifest")


def records(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The WARC records whose gzip members start at byte ``start`` or later and before ``end``."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as file:
        total = file.size()
        at, held = start, b""  # held: the bytes from place ``at`` on
        while at < end:
            p = held.find(MAGIC)
            if p < 0:
                keep = min(2, len(held))
                at, held = at + len(held) - keep, held[len(held) - keep :]
                more = file.read_at(STEP, at + len(held)) if at + len(held) < total else b""
                if not more:
                    return
                held += more
                continue
            at, held = at + p, held[p:]
            if at >= end:
                return
            record, used = _decode(file, total, at, held)
            if record is None:
                used = 1
            else:
                yield record
            if used <= len(held):
                at, held = at + used, held[used:]
            else:
                at, held = at + used, b""


def _decode(file, total: int, at: int, held: bytes) -> tuple[bytes | None, int]:
    """The member at a place and its size, if it decodes to a WARC record."""
    unpacker, out, read, known = zlib.decompressobj(31), [], 0, False
    while True:
        data = held if not read else file.read_at(STEP, at + read) if at + read < total else b""
        if not data:
            return None, 0
        read += len(data)
        try:
            out.append(unpacker.decompress(data))
        except zlib.error:
            return None, 0
        if not known and sum(map(len, out)) >= 7:
            known = True
            if not b"".join(out).startswith(b"WARC/1."):
                return None, 0
        if unpacker.eof:
            return (b"".join(out), read - len(unpacker.unused_data)) if known else (None, 0)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives: page_id, url, record_type, refers_to, declared_bytes, declared_digest, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for raw in records(uri, start, end):
                    if (row := parse(raw)) is not None:
                        rows.append(row)
                        size += len(raw)
                    if size >= OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("uri", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("uri", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    n = ranges.count()
    schema = "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, payload binary"
    return ranges.repartition(max(1, n)).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` through archives and back."""
    return read_archives(pages.sparkSession, write_archives(pages))
