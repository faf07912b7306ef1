"""Whole-text encoding with a public tokenizer, each distinct chunk of text once.

Both tokenizers cut a text into pre-tokens before they merge bytes. A text is therefore cut,
with numpy, only at places where a pre-token surely ends: before or after a single blank or
line feed between two visible Latin characters, and between a Latin letter and ASCII
punctuation other than an apostrophe. The library encodes each distinct chunk; a text's ids
are those of its chunks. Texts in which ``<|`` occurs may hold a special token and go to the
library whole.

New chunks are handed over many at a time, joined by a separator, if they begin and end with a
visible Latin character (one blank may come first) and the separators come back as often as they
were put in; all others, such as those that begin or end with other white space, go one by one. Chunks
are known by a 64-bit hash of their bytes and length; those of over ``LONGEST`` bytes, for which
such hashes can be made to collide, are encoded each time.

Defined results: a null text has no ids; texts of any length, repeats and any characters give the
library's ids.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import _BYTE, mix, powers, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_CHUNKS = 1_000_000  # a worker forgets its chunks beyond this number; results do not depend on it
WINDOW = 1 << 20
NEAR = 1 << 12  # so far back the end of a window is looked for at first
LONGEST = 64
_TABLE = 1 << 21
_MASK = np.uint64(_TABLE - 1)

_LETTER = np.zeros(256, bool)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _VISIBLE & ~_LETTER
_SIGN[[*range(48, 58), 39]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_path(name: str) -> str:
    """Where the public tokenizer files are; tests and callers may give any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes string columns.

    ``lower`` may be set if the tokenizer's own normaliser folds ASCII case. ``separator`` is a
    string of one id that never joins what stands beside it: a line feed where white space has
    ids, a digit where each digit is cut off by itself.
    """

    _loaded: dict[tuple[str, bool, str], Encoder] = {}

    def __init__(self, path: str, lower: bool = False, separator: str = "\n"):
        from tokenizers import Tokenizer

        self.tokenizer, self.lower, self.separator = Tokenizer.from_file(path), lower, separator
        self.once = np.uint64(0)
        (self.mark,) = self.tokenizer.encode(separator, add_special_tokens=False).ids
        self._forget()

    @classmethod
    def load(cls, path: str, lower: bool = False, separator: str = "\n") -> Encoder:
        """One encoder a worker process, with the chunks that it has seen."""
        key = (path, lower, separator)
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, lower, separator)
        return cls._loaded[key]

    def _forget(self) -> None:
        self.count, self.used, self.probes = 1, 0, 1  # entry 0 stands for "not known"
        self.key = np.zeros(_TABLE, np.uint64)
        self.entry = np.zeros(_TABLE, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entries of chunks; 0 where a chunk is not known."""
        place = key & _MASK
        out = np.where(self.key[place] == key, self.entry[place], 0)
        for k in range(1, self.probes):
            open_ = np.flatnonzero(out == 0)
            if not len(open_):
                break
            place = (key[open_] + np.uint64(k)) & _MASK
            out[open_] = np.where(self.key[place] == key[open_], self.entry[place], 0)
        return out

    def _insert(self, key: np.ndarray, entry: np.ndarray) -> None:
        for k in range(_TABLE):
            place = (key + np.uint64(k)) & _MASK
            free = self.entry[place] == 0
            self.key[place[free]], self.entry[place[free]] = key[free], entry[free]
            left = self.entry[place] != entry
            self.probes = max(self.probes, k + 1)
            key, entry = key[left], entry[left]
            if not len(key):
                return

    def _starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where chunks begin; ``bounds`` marks the first byte of each row."""
        n = len(raw)
        start = bounds.copy()
        if n < 3:
            return np.flatnonzero(start)
        latin = np.zeros(n, bool)  # the second byte of a Latin-1 letter
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        ends = _VISIBLE[raw] | latin
        opens = _VISIBLE[raw] | (raw == 0xC3)
        gap = ((raw == 0x20) | (raw == 0x0A))[1:-1] & ends[:-2] & opens[2:]
        start[1:-1] |= gap
        start[2:] |= gap & (raw[1:-1] == 0x0A)
        start[1:] |= _SIGN[raw[1:]] & (_LETTER[raw[:-1]] | latin[:-1])
        return np.flatnonzero(start)

    def _apart(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a separator beside a chunk is surely a pre-token of its own: the chunk has none, and begins and ends with a visible Latin character, maybe after one blank."""
        size = end - start
        marks = np.flatnonzero(raw == ord(self.separator))
        first = start + ((raw[start] == 0x20) & (size > 1))
        second = np.minimum(first + 1, end - 1)
        sign = (raw[second] == 0x97) | (raw[second] == 0xB7)
        opens = _VISIBLE[raw[first]] | ((raw[first] == 0xC3) & (second > first) & ~sign)
        last = end - 1
        closes = _VISIBLE[raw[last]] | ((raw[last - 1] == 0xC3) & (last > start) & (raw[last] != 0x97) & (raw[last] != 0xB7))
        return opens & closes & (np.searchsorted(marks, end) == np.searchsorted(marks, start))

    def _ids(self, chunks: list[str], apart: np.ndarray) -> list[list[int]]:
        """The library's ids of chunks: many at a time those that may stand beside a separator."""
        sep, mark = self.separator, self.mark
        plain = np.flatnonzero(apart).tolist()
        rest = set(np.flatnonzero(~apart).tolist())
        out: list[list[int]] = [[]] * len(chunks)
        joined = [sep.join(chunks[i] for i in plain[k : k + 64]) for k in range(0, len(plain), 64)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids, own, p = found.ids, plain[64 * k : 64 * k + 64], 0
            if ids.count(mark) != len(own) - 1:
                rest.update(own)
                continue
            for i in own[:-1]:
                q = ids.index(mark, p)
                out[i], p = ids[p:q], q + 1
            out[own[-1]] = ids[p:]
        other = sorted(rest)
        for i, found in zip(other, self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def _learn(self, keys: np.ndarray, chunks: list[str], apart: np.ndarray) -> None:
        ids = self._ids(chunks, apart)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        first, end = self.count, self.used + len(flat)
        self.count += len(keys)
        while len(self.begin) < self.count:
            self.begin, self.length = np.concatenate((self.begin, self.begin)), np.concatenate((self.length, self.length))
        while len(self.flat) < end:
            self.flat = np.concatenate((self.flat, self.flat))
        self.flat[self.used : end] = flat
        self.begin[first : self.count] = self.used + np.concatenate(([0], np.cumsum(sizes[:-1])))
        self.length[first : self.count] = sizes
        self.used = end
        self._insert(keys, np.arange(first, self.count, dtype=np.int32))

    def _window(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some bytes; where each chunk begins in the bytes and in the ids."""
        start = self._starts(raw, bounds)
        end = np.append(start[1:], len(raw))
        up, down = powers(len(raw) + 1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
        key = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
        long = np.flatnonzero(end - start > LONGEST)
        key[long] = mix(self.once + np.arange(1, len(long) + 1, dtype=np.uint64))  # names that are used once
        self.once += np.uint64(len(long))
        slot = self._find(key)
        slot[long] = 0
        missing = np.flatnonzero(slot == 0)
        if len(missing):
            if self.count + len(missing) > CACHE_CHUNKS:
                self._forget()
                missing = np.arange(len(key))
            new, where = np.unique(key[missing], return_index=True)
            where = missing[where]
            text = raw.tobytes()
            chunks = [text[p:q].decode("utf-8") for p, q in zip(start[where].tolist(), end[where].tolist())]
            self._learn(new, chunks, self._apart(raw, start[where], end[where]))
            slot[missing] = self._find(key[missing])
        size = self.length[slot].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.begin[slot] - at[:-1], size) + np.arange(at[-1])]
        return ids, start, at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column (null: empty), and n + 1 offsets of its rows into them."""
        raw, rows = utf8(column)
        if self.lower:
            raw = _LOWER[raw]
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) > 1 else np.zeros(0, int)
        whole = set((np.searchsorted(rows, special, side="right") - 1).tolist())
        bounds = np.zeros(len(raw) + 1, bool)
        bounds[rows] = True
        parts, sizes, low = [], np.zeros(len(rows), np.int64), 0
        ids_at = 0
        while low < len(raw):
            high = min(len(raw), low + WINDOW)
            if high < len(raw):  # end at a chunk's start
                near = max(low, high - NEAR)
                last = self._starts(raw[near:high], bounds[near:high])
                if not len(last) or last[-1] == 0:  # a long chunk
                    near, last = low, self._starts(raw[low:high], bounds[low:high])
                if last[-1:].any():
                    high = near + int(last[-1])
                else:
                    more = self._starts(raw[low:], bounds[low:-1])
                    high = low + int(more[more > 0][0]) if (more > 0).any() else len(raw)
            edge = bounds[low:high].copy()
            edge[0] = True
            ids, start, at = self._window(raw[low:high], edge)
            inside = np.flatnonzero((rows >= low) & (rows < high))
            sizes[inside] = ids_at + at[np.searchsorted(start, rows[inside] - low)]
            parts.append(ids)
            ids_at, low = ids_at + len(ids), high
        sizes[rows >= len(raw)] = ids_at
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if whole:
            texts = column.take(pa.array(sorted(whole))).to_pylist()
            own = dict(zip(sorted(whole), (x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))))
            rows_ids = [np.array(own[i], np.uint32) if i in own else ids[sizes[i] : sizes[i + 1]] for i in range(len(sizes) - 1)]
            ids, sizes = np.concatenate(rows_ids), np.concatenate(([0], np.cumsum([len(x) for x in rows_ids])))
        return ids, sizes
