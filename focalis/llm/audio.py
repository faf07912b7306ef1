"""Chroma fingerprints of recordings, and their alignment (operator 7).

A recording is cut into overlapping frames; the energy of each frame's spectrum is folded into
the 12 pitch classes, normalised and smoothed over time. On the integral image of this chroma
picture, 16 rectangle filters each compare two areas; their log ratios, quantised to 2 bits in
Gray code, make one 32-bit integer for every frame at which all filters fit.

Two recordings are aligned by the integers that they share: a histogram of the differences of
their places gives the likely offsets, and the share of differing bits over the overlap at an offset
tells whether they are the same sound. The integers of the queries are joined with those of all
recordings, shared ones counted by pair and offset, and every offset with ``MIN_SHARED`` of them or more
is verified; nothing is collected, and cost follows the number of shared integers. The integers of the
queries are broadcast only while Spark finds the table of classes below its threshold; they are seven
times its bytes at most.
Recordings with equal fingerprints form a class, whose least id stands for all of them, so copies
are never expanded into pairs. The overlap has to be of ``MIN_OVERLAP`` integers, or the whole of the
shorter recording if that has fewer; of a recording of one integer, that one has to be shared.

Defined results: a null, undecodable, silent or too short recording (under ``FRAME + (SPAN - 1) *
HOP`` samples) has no integers, is a class of its own and matches nothing; null ids are kept but are
no queries; of several verified offsets the one with most shared integers counts, then the one with
fewer bit errors, then the smaller; recordings of any length are read whole, their spectra in bounded
memory; repeated rows share a class; other columns, whatever their names, are not read; no rows give
no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import slices, utf8

RATE, FRAME, HOP = 8000, 2048, 512
LOWEST, HIGHEST = 55.0, 3520.0
SPAN = 8  # frames that the widest filter covers
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
LEVELS = (-0.35, 0.0, 0.35)  # between the four values of a filter
#: (shape, first pitch class, pitch classes, frames): shape 0 compares the halves of the pitch
#: range, 1 those of the time range, 2 the quarters crosswise, 3 the middle third of time with the rest
FILTERS = [(k % 4, (5 * k) % 12, 4 + 2 * (k % 3), (4, 6, 8, 6)[k // 4 % 4]) for k in range(16)]
MAX_ERROR, MIN_OVERLAP, MIN_SHARED = 0.25, 32, 2
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples (channels averaged) and rate of a PCM file of 8 or 16 bits; None if it is none."""
    try:
        if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
            return None
        at, kind = 12, None
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"fmt ":
                kind = struct.unpack_from("<HHIIHH", data, at + 8)
            elif name == b"data" and kind and kind[0] == 1 and kind[5] in (8, 16):
                raw = data[at + 8 : at + 8 + size]
                raw = raw[: len(raw) // (kind[1] * kind[5] // 8) * (kind[1] * kind[5] // 8)]
                x = np.frombuffer(raw, "<i2").astype(np.float32) if kind[5] == 16 else (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) * 256
                return x.reshape(-1, kind[1]).mean(axis=1), kind[2]
            at += 8 + size + size % 2
    except (struct.error, ValueError, ZeroDivisionError):
        return None
    return None


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A mono 16-bit file."""
    data = np.clip(samples, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def _classes(rate: int) -> np.ndarray:
    """Spectrum bins x 12: which bin belongs to which pitch class."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12), np.float32)
    use = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12, each of unit length or zero, smoothed over five frames."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    window, fold, out = np.hanning(FRAME).astype(np.float32), _classes(rate), np.empty((n, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    for k in range(0, n, 256):  # bounded memory for recordings of any length
        spectrum = np.fft.rfft(frames[k : k + 256] * window, axis=1)
        out[k : k + 256] = (spectrum.real**2 + spectrum.imag**2) @ fold
    out = np.sqrt(out)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(size > 1, out / np.maximum(size, 1e-9), 0)
    if n < len(SMOOTHING):
        return out
    return np.stack([np.convolve(out[:, c], SMOOTHING / SMOOTHING.sum(), "same") for c in range(12)], axis=1)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The 32-bit integers of a recording; none if it is silent or shorter than a filter."""
    picture = chroma(samples, rate)
    n = len(picture) - SPAN + 1
    if n < 1 or not picture.any():
        return np.zeros(0, np.uint32)
    # pitch classes wrap around: two octaves of the picture, so that any range is one rectangle
    image = np.zeros((len(picture) + 1, 25))
    image[1:, 1:] = np.concatenate((picture, picture), axis=1).cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[t1 : t1 + n, c1] - image[t0 : t0 + n, c1] - image[t1 : t1 + n, c0] + image[t0 : t0 + n, c0]

    out = np.zeros(n, np.uint32)
    for shape, first, classes, frames in FILTERS:
        half_c, half_t, last = first + classes // 2, frames // 2, first + classes
        if shape == 0:
            a, b = area(0, frames, first, half_c), area(0, frames, half_c, last)
        elif shape == 1:
            a, b = area(0, half_t, first, last), area(half_t, frames, first, last)
        elif shape == 2:
            a = area(0, half_t, first, half_c) + area(half_t, frames, half_c, last)
            b = area(0, half_t, half_c, last) + area(half_t, frames, first, half_c)
        else:
            third = max(1, frames // 3)
            a = area(third, frames - third, first, last)
            b = area(0, third, first, last) + area(frames - third, frames, first, last)
        level = np.digitize(np.log((a + 0.1) / (b + 0.1)), LEVELS).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    """The share of differing bits of two runs of integers of equal length."""
    x = np.bitwise_xor(a, b)
    return float(_BITS[x & 0xFFFF].sum(dtype=np.int64) + _BITS[x >> np.uint32(16)].sum(dtype=np.int64)) / (32 * len(a))


def overlap(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The common parts if b starts ``offset`` frames after the start of a."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    return a[low:high], b[low - offset : max(low, high) - offset]


def verified(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int] | None:
    """The share of bit errors and the overlap at an offset, if they are the same sound there."""
    x, y = overlap(a, b, offset)
    if len(x) < min(MIN_OVERLAP, len(a), len(b)) or not len(x):
        return None
    error = bit_errors(x, y)
    return (error, len(x)) if error <= MAX_ERROR else None


# --- on tables


def fingerprints(rows: DataFrame, key: str, media: str, decode: Callable = read_wav) -> DataFrame:
    """id and integers (little-endian u32, empty if there are none); ``decode`` turns a value into samples and rate, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sounds = (decode(x) for x in part.column(1).to_pylist())
                prints = [b"" if s is None else fingerprint(*s).astype("<u4").tobytes() for s in sounds]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(media)).mapInArrow(run, "id long, print binary")


def _integers(classes: DataFrame) -> DataFrame:
    """num, n (integers of its recording), value, place of every integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "print", 1 << 20):
                raw, at = utf8(part.column(1))
                size = np.diff(at) // 4
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.asarray(part.column(0)), size)),
                    pa.array(np.repeat(size, size)),
                    pa.array(np.frombuffer(raw.tobytes(), "<u4").view(np.int32)),
                    pa.array(place),
                ], names=["num", "n", "value", "place"])

    return classes.select("num", "print").mapInArrow(run, "num long, n long, value int, place long")


def _matches(classes: DataFrame) -> DataFrame:
    """query, match (numbers of classes), offset, bit_error, frames of all queries and the classes that they match."""
    every = _integers(classes)
    wanted = _integers(classes.filter("wanted")).select(F.col("num").alias("query"), F.col("n").alias("m"), "value", F.col("place").alias("at"))
    shared = every.join(wanted, "value").groupBy("query", "num", F.least("m", "n").alias("shorter"), (F.col("at") - F.col("place")).alias("offset")).agg(F.count("*").alias("shared"))
    likely = shared.filter(F.col("shared") >= F.least(F.lit(MIN_SHARED), "shorter")).groupBy("query", "num").agg(F.collect_list(F.struct("offset", "shared")).alias("offsets"))
    likely = written(likely, "likely-offsets")
    prints = classes.select("num", "print")
    pairs = likely.join(prints, "num").join(prints.select(F.col("num").alias("query"), F.col("print").alias("query_print")), "query").select("query", "num", "offsets", "print", "query_print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, num, offsets, print_, query_print in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(query_print, "<u4"), np.frombuffer(print_, "<u4")
                found = ((-o["shared"], v[0], o["offset"], v[1]) for o in offsets if (v := verified(a, b, o["offset"])))
                if best := min(found, default=None):
                    out.append((query, num, best[2], best[1], best[3]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["query", "num", "offset", "bit_error", "frames"])

    return pairs.mapInArrow(run, "query long, num long, offset long, bit_error double, frames long")


def search(prints: DataFrame, queries: str = "id % 100 = 0") -> DataFrame:
    """All recordings (id, class_id, is_query); queries with a row for each class that they match: match_class, offset, bit_error, frames."""
    rows = written(prints.withColumn("name", F.when(F.length("print") > 0, F.sha2("print", 256))).withColumn("is_query", F.coalesce(F.expr(queries), F.lit(False))), "prints")
    classes = rows.filter("name is not null").groupBy("name").agg(F.min("id").alias("class_id"), F.max("is_query").alias("wanted"), F.any_value("print").alias("print"))
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "print-classes")
    names = classes.select("num", "name", "class_id")
    found = _matches(classes).join(names.select("num", F.col("class_id").alias("match_class")), "num")
    found = found.join(names.select(F.col("num").alias("query"), F.col("name").alias("query_name")), "query").select("query_name", "match_class", "offset", "bit_error", "frames")
    found = written(found, "print-matches")
    all_rows = rows.join(names.drop("num"), "name", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "is_query", F.when(F.col("is_query"), F.col("name")).alias("query_name"))
    return all_rows.join(found, "query_name", "left").select("id", "class_id", "is_query", "match_class", "offset", "bit_error", "frames")


# --- sound for a table without any

NOTE = 512


def tones(values: list[float] | None) -> tuple[np.ndarray, int] | None:
    """A vector as a melody: each component is a note of 64 ms, its value the pitch in semitones around 440 Hz."""
    if not values:
        return None
    table = _tones()
    x = np.nan_to_num(np.array([v or 0.0 for v in values], np.float64))
    pitch = np.clip(np.round(18 * np.tanh(4 * x)).astype(int) + 18, 0, 36)
    return table[pitch].ravel(), RATE


def _tones(_made: list = []) -> np.ndarray:  # noqa: B006  made once a process
    if not _made:
        t = np.arange(NOTE) / RATE
        fade = np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 40)
        f = 440 * 2 ** ((np.arange(37) - 18) / 12)
        _made.append((8000 * fade * (np.sin(2 * np.pi * f[:, None] * t) + 0.4 * np.sin(4 * np.pi * f[:, None] * t))).astype(np.float32))
    return _made[0]
