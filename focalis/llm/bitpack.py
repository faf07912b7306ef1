"""Token ids in files of fixed-width, bit-packed blocks (operator 3).

A shard file holds the ids of a run of documents in ascending id order:

    b"FBPK" | block, block, ... | index | index length (u64) | b"FBPK"

Each block packs ``BLOCK`` ids (the last one fewer), ``bits`` bits each, least significant bit
first, where ``bits`` is the least that the vocabulary needs. The index holds the bit width,
the block offsets, and each document's id and the place of its first id, so any run of ids is
unpacked with numpy after reading its blocks alone.

Documents are dealt to shards by id, then by a hash of the text, then by their place in the input
(which has to be the same whenever it is read, as that of files is), so many rows with one id, none or
one text do not make one shard. A task holds fewer than ``BLOCK`` ids and the rows of a slice;
packed blocks go straight to the file.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` sorts first and
comes back as null; repeated rows are separate documents, those of one id in the order of a hash of
their text; texts may be of any length; no rows give no shard; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import Encoder, default_path
from .shared import filesystem, fresh, new_file, written
from .words import slices

MAGIC = b"FBPK"
BLOCK = 1 << 16
ROWS_PER_SHARD = 10_000
SHARD_BYTES = 64 << 20  # of text on average, at most


def width(vocabulary: int) -> int:
    """The least number of bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    one = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(one.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    one = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (one.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes one shard to a stream as ids come in; holds fewer than BLOCK loose ids."""

    def __init__(self, bits: int, out):
        self.bits, self.out, self.offsets, self.at, self.total = bits, out, [], len(MAGIC), 0
        self.loose: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[int | None] = []
        self.starts: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, at: np.ndarray) -> None:
        if not len(docs):
            return
        self.docs += docs
        self.starts.append(self.total + at[:-1])
        self.total += len(ids)
        self.loose.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            held, p = np.concatenate(self.loose), 0
            while len(held) - p >= BLOCK:
                self._block(held[p : p + BLOCK])
                p += BLOCK
            self.loose, self.waiting = [held[p:].copy()], len(held) - p

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.loose))
        starts = np.concatenate([*self.starts, [self.total]]).astype("<i8")
        known = np.array([d is not None for d in self.docs], np.uint8)
        index = b"".join((
            struct.pack("<IIQQQ", self.bits, BLOCK, self.total, len(self.docs), len(self.offsets)),
            np.array([*self.offsets, self.at], "<i8").tobytes(),
            starts.tobytes(),
            np.array([d or 0 for d in self.docs], "<i8").tobytes(),
            known.tobytes(),
        ))
        for part in (index, struct.pack("<Q", len(index)), MAGIC):
            self.out.write(part)


class Reader:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"not a packed shard: {uri}")
        length = struct.unpack("<Q", tail[:8])[0]
        raw = self.file.read_at(length, size - 12 - length)
        self.bits, self.block, self.total, n, blocks = struct.unpack_from("<IIQQQ", raw)
        p = struct.calcsize("<IIQQQ")
        self.offsets = np.frombuffer(raw, "<i8", blocks + 1, p)
        self.starts = np.frombuffer(raw, "<i8", n + 1, p := p + 8 * (blocks + 1))
        ids = np.frombuffer(raw, "<i8", n, p := p + 8 * (n + 1))
        known = np.frombuffer(raw, np.uint8, n, p + 8 * n).astype(bool)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids at places low to high, from the blocks that hold them alone."""
        if low >= high:
            return np.zeros(0, np.uint32)
        a, b = low // self.block, (high - 1) // self.block
        raw = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            p = int(self.offsets[k] - self.offsets[a])
            out.append(unpack(raw[p : p + int(self.offsets[k + 1] - self.offsets[k])], self.bits, min(self.block, self.total - k * self.block)))
        return np.concatenate(out)[low - a * self.block : high - a * self.block]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with one more id at the end of each."""
    return np.insert(ids, at[1:], end).astype(np.uint32), at + np.arange(len(at))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, lower: bool = False, separator: str = "\n", vocabulary: int = 0, rows_per_shard: int = ROWS_PER_SHARD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``docs`` and write the shards; returns the manifest (shard, uri, docs, ids), itself written."""
    spark = docs.sparkSession
    folder = fresh(spark, "packed-ids")
    count, length = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n = max(1, -(-count // rows_per_shard), -(-length // SHARD_BYTES))
    size = vocabulary or _vocabulary(tokenizer)
    if not end_id < size:
        raise ValueError("the end id lies outside the vocabulary")
    bits = width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Encoder.load(tokenizer, lower, separator), TaskContext.get().partitionId()
        parts = (part for batch in batches for part in slices(batch))
        first = next(parts, None)
        if first is None:
            return
        uri = f"{folder}/shard-{shard:08d}.ids"
        with new_file(uri) as file:
            out = Writer(bits, file)
            for part in chain([first], parts):
                ids, at = with_end(*coder.encode(part.column(1)), end_id)
                out.add(part.column(0).to_pylist(), ids, at)
            out.finish()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "docs": pa.array([len(out.docs)], pa.int64()), "ids": pa.array([out.total], pa.int64())})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("place"))
    order = ("doc_id", "th", "place")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(rows.mapInArrow(run, "shard int, uri string, docs long, ids long"), "packed-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id, start (ids before it over all shards), n_tokens, ids (little-endian u32).

    Only the manifest, a row a shard, is gathered, to turn counts into places.
    """
    shards, start = [], 0
    for r in manifest.orderBy("shard").collect():
        shards.append((r.uri, start))
        start += r.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns)):
                file, d = Reader(uri), 0
                while d < len(file.docs):
                    e = max(d + 1, int(np.searchsorted(file.starts, file.starts[d] + 16 * BLOCK)) - 1)
                    low = int(file.starts[d])
                    data = file.ids(low, int(file.starts[e])).astype("<u4").tobytes()
                    at = ((file.starts[d : e + 1] - low) * 4).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.docs[d:e], pa.int64()),
                        "start": pa.array(before + file.starts[d:e]),
                        "n_tokens": pa.array(np.diff(file.starts[d : e + 1])),
                        "ids": pa.array([data[p:q] for p, q in zip(at, at[1:])], pa.binary()),
                    })
                    d = e

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(shards, "uri string, before long").repartition(len(shards))
    return places.mapInArrow(run, schema)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """``docs`` through packed files and back, with the 49k word tokenizer unless another is named."""
    word = tokenizer is None
    manifest = write_shards(docs, tokenizer or default_path("word_bpe_49k.json"), end_id, lower=word, separator="0" if word else "\n")
    return read_shards(docs.sparkSession, manifest)
