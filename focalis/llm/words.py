"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of letters, digits and other non-ASCII characters; ASCII
punctuation, white space, the Latin-1 signs and general punctuation separate words.
Case is folded. Words are only ever handled as 64-bit hashes, computed for a whole
batch at once: the hash of bytes ``b[s:e]`` is ``sum(T[b[i]] * P**(i - s))`` modulo
2**64, read off one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # rows are handled in slices of about this much text
WINDOW_BYTES = 1 << 20  # and the bytes of a slice in windows of about this size

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_PRIME, _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``limit`` bytes of text, one row at least."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _fold(raw: np.ndarray) -> np.ndarray:
    """Bytes with letter case folded and zeros for separators."""
    b = _FOLD[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[lead + 1 < len(raw)]
    second = raw[lead + 1]
    b[lead[second == 0x97]] = b[lead[second == 0x97] + 1] = 0  # multiplication sign
    b[lead[second == 0xB7]] = b[lead[second == 0xB7] + 1] = 0  # division sign
    upper = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    b[upper + 1] += 0x20
    sign = np.flatnonzero(raw == 0xC2)
    sign = sign[sign + 1 < len(raw)]
    sign = sign[~np.isin(raw[sign + 1], (0xAA, 0xB5, 0xBA))]
    b[sign] = b[sign + 1] = 0
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        p = np.flatnonzero(raw == first)
        p = p[p + 2 < len(raw)]
        p = p[np.isin(raw[p + 1], seconds)]
        b[p] = b[p + 1] = b[p + 2] = 0
    return b


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and n + 1 offsets of its rows into them."""
    raw, at = utf8(column)
    if len(raw) and (raw >= 0xC4).any():
        raw, at = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    out: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    low = 0
    b = _fold(raw)
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    while low < len(raw):
        high = min(len(raw), low + WINDOW_BYTES)
        if high < len(raw):
            gaps = np.flatnonzero((b[low:high] == 0) | cut[low:high])
            if len(gaps) and gaps[-1]:
                high = low + int(gaps[-1])
            else:
                later = np.flatnonzero((b[high:] == 0) | cut[high:-1])
                high = high + int(later[0]) if len(later) else len(raw)
        part, bounds = b[low:high], cut[low:high]
        word = part != 0
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | bounds))
        ending = word.copy()
        ending[:-1] &= ~word[1:] | bounds[1:]
        end = np.flatnonzero(ending) + 1
        up, down = powers(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=run[1:])
        out.append(mix((run[end] - run[start]) * down[start]))
        begins.append(start + low)
        low = high
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(begins), at).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within rows, repeats included; a row of fewer words has one, of all its words."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate(([0], np.cumsum(count)))
    factor = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    if len(hashes) >= size:
        m = len(hashes) - size + 1
        every = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            every[:m] += hashes[k : k + m] * factor[k]
    else:
        every = np.zeros(len(hashes), np.uint64)
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + np.arange(out_at[-1]) - out_at[:-1][row]
    out = every[first]
    for i in np.flatnonzero((n > 0) & (n < size)):
        w = hashes[at[i] : at[i + 1]]
        out[out_at[i]] = (w * factor[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), out_at
