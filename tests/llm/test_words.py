import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from focalis.llm import words as W

ALPHABET = "abAB zZéÉß×½ .,\n\t1中’—’ñÑ´"


def plain(text):
    """The definition, one word at a time."""
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in text or "")
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f\u0080-©«-´¶-¹»-¿×÷ -ⁿ　-〿])+", low)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40)), min_size=1, max_size=8))
def test_words(texts):
    hashes, at = W.words(pa.array(texts, pa.string()))
    seen, back = {}, {}
    for i, t in enumerate(texts):
        own = plain(t)
        assert at[i + 1] - at[i] == len(own)
        for w, h in zip(own, hashes[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_windows_and_slices_do_not_matter(monkeypatch):
    texts = pa.array([None, "", "aa bb " * 50, "x" * 70, "é" * 33 + " y", "Q " * 9])
    whole = W.words(texts)
    monkeypatch.setattr(W, "WINDOW_BYTES", 16)
    cut = W.words(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(W.slices(batch, limit=20))
    assert sum(p.num_rows for p in parts) == 6 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_shingles():
    h, at = W.words(pa.array(["a b c d e f", "a b c d e", "a b", "", "b a"]))
    s, p = W.shingles(h, at)
    assert np.diff(p).tolist() == [2, 1, 1, 0, 1]
    assert s[0] == s[2] and len(set(s.tolist())) == 4
