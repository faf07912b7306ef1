"""Benchmark decontamination by spaced-seed hashing (operator 1).

Fixed masks choose which words of a span count. The hash of the chosen words is taken at every
place of every document and joined with the same hashes of the benchmark; whatever the ignored
words are, equal chosen words meet. Around each hit the document and the item are laid on one
diagonal, and the document leaks the item if some ``WINDOW`` aligned words (the whole item, if
that is shorter) agree in all but ``SUBSTITUTIONS`` places. The masks are such that any two
substitutions in a window of 13 words leave at least one of them untouched, and so does the one
substitution that items of 10 to 12 words allow. Items of 8 and 9 words, too short for most places
of these masks, have a mask of four words more, which fits beside any one substitution. Items of
fewer than ``SHORTEST`` words have to occur word for word: for each of these lengths a mask takes all
words of the item.

A benchmark of up to ``BROADCAST_WORDS`` words (a word counted as two characters at least) is
handed to the workers in parts of at most ``PART_WORDS`` words, each pass piped into the next. For
a larger one nothing is collected or broadcast: seeds of both sides are joined by a shuffle, and
the words of documents and items meet at the distinct places where they agree in a seed.

Defined results: a null or empty text leaks nothing; items that are null or have no word match
nothing; an item without an id makes documents leak but is not named; repeated documents are judged
alike, repeated items count once in ``item_ids``; of several alignments the one with most agreeing
words gives ``best_overlap``; texts of any length are read whole, in slices of bounded size, a text
at least; an empty benchmark leaves all documents clean; columns other than the text are carried
along unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused, written
from .words import mix, slices, words

MASKS = ("11110111", "11011001011", "1100101111", "111101011")
WINDOW, SUBSTITUTIONS = 13, 2
SHORTEST = 8
#: One more mask for items of fewer words than ``SHORT``.
SHORT_MASK, SHORT = "1111", 10
#: All masks with the least and most words of the items that they are for.
LONGEST = 1 << 62
ALL_MASKS = [(m, SHORTEST, LONGEST) for m in MASKS] + [(SHORT_MASK, SHORTEST, SHORT - 1)] + [("1" * n, n, n) for n in range(1, SHORTEST)]
PART_WORDS, BROADCAST_WORDS = 250_000, 1_000_000
HITS = 1 << 20  # places that are laid out at once
_FACTOR = mix(np.arange(101, 132, dtype=np.uint64)) | np.uint64(1)


def seeds(w: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the chosen words at each place where the mask fits."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += w[k : k + n] * _FACTOR[k]
    return mix(out)


def item_seeds(at: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask its number, the seeds of the items that it is for, and their places in ``w``."""
    size = np.diff(at)
    item = np.repeat(np.arange(len(size)), size)
    for k, (mask, least, most) in enumerate(ALL_MASKS):
        h = seeds(w, mask, k)
        place = np.arange(len(h))
        own = item[: len(h)]
        ok = (place + len(mask) <= at[1:][own]) & (size[own] >= least) & (size[own] <= most)
        yield k, h[ok], place[ok]


def agreeing(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
    """How many words agree if the item starts ``shift`` words after the document's start; 0 if that is no leak."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    if high - low < window:
        return 0
    same = doc[shift + low : shift + high] == item[low:high]
    run = np.concatenate(([0], np.cumsum(same)))
    allowed = SUBSTITUTIONS * window // WINDOW if window >= SHORTEST else 0
    return int(run[-1]) if (run[window:] - run[:-window]).max() >= window - allowed else 0


class Index:
    """Seeds of a bounded part of the benchmark, and its words for the check around a hit."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        w, at = words(pa.array(texts, pa.string()))
        self.ids, self.words, self.at = ids, w, at
        self.item = np.repeat(np.arange(len(ids)), np.diff(at))
        self.tables = []
        for k, h, place in item_seeds(at, w):
            if len(h):
                order = np.argsort(h, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[(h >> np.uint64(44)).astype(np.int64)] = True
                self.tables.append((k, h[order], place[order], maybe))

    def leaks(self, w: np.ndarray, at: np.ndarray) -> dict[int, dict[int, int]]:
        """For each row that leaks: its items and how many words agree, for the best alignment of each."""
        found: set[tuple[int, int, int]] = set()
        for k, known, place, maybe in self.tables:
            mask = ALL_MASKS[k][0]
            h = seeds(w, mask, k)
            if not len(h):
                continue
            p = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(known, h[p], "left"), np.searchsorted(known, h[p], "right")
            p, low, high = p[high > low], low[high > low], high[high > low]
            row = np.searchsorted(at, p, side="right") - 1
            ok = p + len(mask) <= at[row + 1]
            p, row, low, high = p[ok], row[ok], low[ok], high[ok]
            total = np.cumsum(high - low)
            begin = 0
            while begin < len(p):  # hits in bounded memory, those of one place at least
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, side="right")))
                n = high[begin:end] - low[begin:end]
                q = place[np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                r, item = np.repeat(row[begin:end], n), self.item[q]
                shift = np.repeat(p[begin:end], n) - at[r] - (q - self.at[item])
                found.update(map(tuple, np.unique(np.stack((r, item, shift), axis=1), axis=0).tolist()))
                begin = end
        out: dict[int, dict[int, int]] = {}
        for row, item, shift in sorted(found):
            if n := agreeing(w[at[row] : at[row + 1]], self.words[self.at[item] : self.at[item + 1]], shift):
                own = out.setdefault(row, {})
                own[item] = max(own.get(item, 0), n)
        return out


def _items(benchmark: DataFrame, text: str, key: str) -> DataFrame:
    return benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")


def _least_words(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> int:
    return (_items(benchmark, text, key).agg(F.sum(F.length("text"))).first()[0] or 0) // 2


def indexes(benchmark: DataFrame, text: str = "text", key: str = "item_id", part_words: int = PART_WORDS) -> list:
    """The benchmark's index, broadcast in parts of about ``part_words`` words."""
    spark = benchmark.sparkSession
    rows = _items(benchmark, text, key)
    parts = max(1, -(-_least_words(benchmark, text, key) // part_words))
    out = []
    for k in range(parts):
        own = sorted(rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect(), key=lambda r: (r.id is None, r.id or 0, r.text))
        if own:
            out.append(spark.sparkContext.broadcast(Index([r.id for r in own], [r.text for r in own])))
    return out


# --- large benchmarks


def _seed_rows(rows: DataFrame, key: str, items: bool) -> DataFrame:
    """seed, place and ``key`` for all places of all texts (of items: the seeds of the masks that they are for)."""
    schema = f"{key} long, seed long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                w, at = words(part.column(1))
                own = np.asarray(part.column(0))
                row = np.repeat(np.arange(len(own)), np.diff(at))
                if items:
                    found = item_seeds(at, w)
                else:
                    found = ((k, h := seeds(w, m, k), np.arange(len(h))) for k, (m, _, _) in enumerate(ALL_MASKS))
                for k, h, place in found:
                    ok = place + len(ALL_MASKS[k][0]) <= at[1:][row[place]]
                    h, place = h[ok], place[ok]
                    if len(h):
                        r = row[place]
                        yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(h.view(np.int64)), pa.array(place - at[r])], names=[key, "seed", "place"])

    return rows.select(key, "text").mapInArrow(run, schema)


def joined_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Documents with a number ``_n`` each, written, and _n, item_id, n (agreeing words) of their leaks, found by joins."""
    number = unused("_n", docs.columns)
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "documents-numbered")
    items = written(_items(benchmark, item_text, item_key).distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    texts = rows.select(F.col(f"`{number}`").alias("doc"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    known = _seed_rows(items, "item", True)
    # Spark takes seeds to be as many as the bytes they are made from, and would broadcast them; a hot seed is split at run time
    hits = _seed_rows(texts, "doc", False).join(known.withColumnRenamed("place", "q").hint("merge"), "seed")
    places = hits.select("doc", "item", (F.col("place") - F.col("q")).alias("shift")).distinct()
    places = written(places, "seed-hits")
    asked = places.join(items.select("item", F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item").join(texts, "doc").select("doc", "item_id", "shift", "item_text", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                (w, at), (v, to) = words(part.column(4)), words(part.column(3))
                shifts = part.column(2).to_pylist()
                n = [agreeing(w[at[k] : at[k + 1]], v[to[k] : to[k + 1]], shifts[k]) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc", "item_id", "n"])

    return rows, asked.mapInArrow(check, "doc long, item_id long, n long").filter("n > 0").withColumnRenamed("doc", number)


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, step: Callable, schema: T.StructType) -> DataFrame:
    for held in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    yield step(part, held.value, held.value.leaks(*words(part.column(part.schema.get_field_index(text)))))

        docs = docs.mapInArrow(run, schema)
    return docs


def leak_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row a document: doc_id, contaminated, item_ids (ascending), best_overlap (agreeing words of its best alignment)."""
    if _least_words(benchmark) > broadcast_words:
        rows, found = joined_leaks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark)
        best = found.groupBy("_n").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n").alias("best_overlap"))
        ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
        return rows.join(best, "_n", "left").select("doc_id", F.col("best_overlap").isNotNull().alias("contaminated"), ids.alias("item_ids"), F.coalesce("best_overlap", F.lit(0)).cast("long").alias("best_overlap"))

    def step(part: pa.RecordBatch, index: Index, leaks: dict) -> pa.RecordBatch:
        items, best = part.column(2).to_pylist(), part.column(3).to_pylist()
        for row, own in leaks.items():
            items[row] = sorted({*items[row], *(index.ids[i] for i in own if index.ids[i] is not None)})
            best[row] = max(best[row], *own.values())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.int64())], names=["doc_id", "text", "item_ids", "best_overlap"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<bigint>").alias("item_ids"), F.lit(0).cast("long").alias("best_overlap"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text"], T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("best_overlap", T.LongType())])
    found = _passes(rows, benchmark, "text", step, schema)
    return found.select("doc_id", (F.col("best_overlap") > 0).alias("contaminated"), "item_ids", "best_overlap")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that leak nothing, with all their columns."""
    if _least_words(benchmark) > broadcast_words:
        rows, found = joined_leaks(docs, benchmark, text)
        number = next(c for c in rows.columns if c not in docs.columns)
        return rows.join(found.select(number).distinct(), number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

    def step(part: pa.RecordBatch, index: Index, leaks: dict) -> pa.RecordBatch:
        keep = np.ones(part.num_rows, bool)
        keep[list(leaks)] = False
        return part.filter(pa.array(keep))

    return _passes(docs, benchmark, text, step, docs.schema)
