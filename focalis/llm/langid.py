"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Text is lower-cased and cut into words of letters; n-grams of 2 to 4 characters, word ends
included, are hashed into ``2**BITS`` buckets. Training sums bucket counts by language on the
executors; the driver gets at most that many counts a language, smooths them and broadcasts the
matrix of log-probabilities. A slice of documents is scored at once: the rows of the matrix that
its n-grams hit, summed by document.

The classifier is fitted on a sample of at most about ``MAX_TRAIN_DOCS`` labelled documents,
chosen by a hash of the document; every document is scored over its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from. A null ``doc_id`` counts as the empty string for the fold.
Equal scores go to the language first in alphabetical order; repeated rows are scored alike; texts
of any length are read whole, in slices of bounded size, a text at least; documents without a label
or text are not learned from; other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, slices

BITS = 16
ORDERS = (2, 3, 4)
MAX_TRAIN_DOCS = 20_000
SMOOTHING = 0.5
SLICE = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the buckets of all n-grams and where each row's begin; and which rows have a letter."""
    low = ["\n" + (t or "").lower() for t in texts]
    code = np.frombuffer("".join((*low, "\n")).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))))
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at] = True
    x = np.where(letter, code, 0)[keep].astype(np.uint64)
    place = np.concatenate(([0], np.cumsum(keep)))[at]
    some = np.diff(np.concatenate(([0], np.cumsum(letter)))[at]) > 0
    buckets, begins = [], []
    for k in ORDERS:
        n = max(0, len(x) - k + 1)
        h = np.full(n, k, np.uint64)
        inner = np.ones(n, bool)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + x[j : j + n]
            if 0 < j < k - 1:
                inner &= x[j : j + n] > 0
        if k == 2:
            inner &= (x[:n] > 0) | (x[1 : 1 + n] > 0)
        use = np.flatnonzero(inner)
        buckets.append((mix(h[use]) >> np.uint64(64 - BITS)).astype(np.int64))
        begins.append(np.searchsorted(use, place))
    return buckets, begins, some


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and log-probabilities (buckets x languages, the last row the priors)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang")).filter("lang is not null and text is not null")
    n = rows.count()
    if n > max_docs:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                buckets, begins, some = ngrams(part.column(0).to_pylist())
                for i, lang in enumerate(part.column(1).to_pylist()):
                    own = total.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                    for b, at in zip(buckets, begins):
                        np.add.at(own, b[at[i] : at[i + 1]], 1)
                    own[-1] += bool(some[i])
        for lang, own in total.items():
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(hit), "bucket": pa.array(hit, pa.int32()), "n": pa.array(own[hit], pa.int64())})

    # the sample is small and spread thinly: few tasks, so that few vectors are summed
    sums = rows.select("text", "lang").repartition(8).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums.lang.unique())
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    counts = np.zeros(((1 << BITS) + 1, len(langs)))
    counts[sums.bucket.to_numpy(), np.searchsorted(langs, sums.lang.to_numpy(str))] = sums.n.to_numpy()
    logs = np.log(counts[:-1] + SMOOTHING) - np.log(counts[:-1].sum(axis=0) + SMOOTHING * (1 << BITS))
    prior = np.log(counts[-1:] + 1) - np.log((counts[-1:] + 1).sum())
    return langs, np.concatenate((logs, prior)).astype(np.float32)


def scores(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its probability."""
    buckets, begins, some = ngrams(texts)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    total = np.repeat(logs[-1:].astype(np.float64), len(texts), axis=0)
    for b, at in zip(buckets, begins):
        rows = np.flatnonzero(np.diff(at) > 0)
        if len(rows):
            total[rows] += np.add.reduceat(logs[b], at[rows], axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(some, 1 / share.sum(axis=1), 0.0)
    return [langs[i] if s else "und" for i, s in zip(best, some)], score


def fold(key: str = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _scored(docs: DataFrame, model: tuple[list[str], np.ndarray], step, schema) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield step(part, *scores(part.column(part.schema.get_field_index("text")).to_pylist(), *held.value))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""

    def step(part: pa.RecordBatch, pred: list[str], score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", fold().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _scored(rows, model, step, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The documents with a language of probability ``least`` or more, with all their columns."""

    def step(part: pa.RecordBatch, pred: list[str], score: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score)]))

    return _scored(docs, model, step, docs.schema)
