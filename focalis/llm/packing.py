"""Packing of documents into windows of near-equal length by multiway differencing (operator 5).

A document's ids (with an end id) give as many full windows as they hold; what remains is cut
into pieces of at most ``max_piece`` ids. The remainders of a group of documents go to windows
by the Karmarkar-Karp differencing method: partial partitions, each a list of window sums, are
merged two by two, the largest difference first, the largest sums of one with the smallest of
the other. If a window then exceeds the capacity, the number of windows rises by one and the
group is partitioned anew. Every remainder has a number of its own, by whose hash it is dealt to a
group; a group holds about ``docs_per_group`` remainders of under one window each, so no group
grows with the data, whatever the ids are.

Defined results: a null or empty text is the end id alone; null and repeated ids are documents of
their own, repeated rows too; texts of any length are cut into windows as they are encoded; equal
lengths are merged in the order of id, then text; of several windows with equal sums the first made
is merged first; columns other than id and text, whatever their names, are not read; no rows give no
pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitpack import with_end
from .encoding import Encoder, default_path
from .shared import written
from .words import slices

CAPACITY = 1024
MAX_PIECE = 256
DOCS_PER_GROUP = 1024
FULL = 1 << 61  # sequence ids of windows that one document fills start here


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of ``sizes`` in k near-equal parts (some may be empty).

    A partial partition keeps its non-zero sums in descending order; of each part it keeps a
    tree of members, flattened at the end.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap: list = [(-s, i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        p, q = len(a), len(b)
        both = max(0, p + q - k)  # so many of the smallest of a meet the smallest of b, in opposite order
        sums = np.concatenate((a[: p - both], a[p - both :] + b[q - both :][::-1], b[: q - both]))
        members = in_a[: p - both] + [(x, y) for x, y in zip(in_a[p - both :], in_b[q - both :][::-1])] + in_b[: q - both]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, [members[i] for i in order.tolist()]))
        tie += 1
    parts = []
    for tree in heap[0][3]:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                flat.append(x)
        parts.append(sorted(flat))
    return parts + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of which none exceeds the capacity.

    Their number starts from the sum and rises until the largest fits: each time by as much as it
    would take if all sums shrank alike, by one at least.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("a piece exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        most = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if most <= capacity:
            return [p for p in parts if p]
        k = max(k + 1, -(-k * most // capacity)) if k < len(sizes) else k + 1


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, most: int) -> list[int]:
    """Ends of near-equal pieces of at most ``most`` of n ids."""
    k = -(-n // most)
    return [n * (i + 1) // k for i in range(k)]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, docs_per_group: int = DOCS_PER_GROUP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    groups = max(1, -(-docs.count() // docs_per_group))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = Encoder.load(tokenizer), 1 + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in slices(batch):
                ids, at = with_end(*coder.encode(part.column(1)), end_id)
                data, rows = ids.astype("<u4").tobytes(), []
                for doc, p, q in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for start in range(0, q - p, capacity):
                        n = min(capacity, q - p - start)
                        # full windows are sequences already; remainders get negative numbers until they are packed
                        rows.append((doc, start, n, data[4 * (p + start) : 4 * (p + start + n)], q - p, FULL + number if n == capacity else -number, 0))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        ids, starts, held = (table.column(c).to_pylist() for c in ("doc_id", "start", "ids"))
        tokens = table.column("doc_tokens").to_pylist()
        rows = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, held[i]))
        pieces = []
        for i in rows:
            low = 0
            for high in cuts(len(held[i]) // 4, max_piece):
                pieces.append((ids[i], starts[i] + low, high - low, held[i][4 * low : 4 * high], tokens[i]))
                low = high
        out = []
        for w, members in enumerate(windows([p[2] for p in pieces], capacity)):
            offset = 0
            for i in members:
                out.append((*pieces[i], (key[0].as_py() << 24) + w, offset))
                offset += pieces[i][2]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(rows.mapInArrow(encode, PIECES), "pieces")
    rest = pieces.filter("sequence_id < 0").withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("long"))
    packed = rest.groupBy("_group").applyInArrow(fill, PIECES)
    return pieces.filter("sequence_id > 0").unionByName(packed)
