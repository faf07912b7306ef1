import math
from collections import Counter

import numpy as np
import pytest

from focalis.llm import langid as L

DIR = "/root/testdata/sf0.01/documents.parquet"


def plain_ngrams(text):
    """The n-grams of each order, by definition."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [Counter(f" {w} "[i : i + k] for w in words for i in range(len(w) + 3 - k)) for k in L.ORDERS]


def test_ngrams():
    texts = ["Ab, abc!", None, "", "É é", "123 x", "中文"]
    buckets, begins, some = L.ngrams(texts)
    names = {}
    for b, at, k in zip(buckets, begins, range(3)):
        for i, t in enumerate(texts):
            own = plain_ngrams(t)[k]
            assert at[i + 1] - at[i] == sum(own.values())
            assert sorted(Counter(b[at[i] : at[i + 1]].tolist()).values()) == sorted(own.values())
            names |= own
    assert some.tolist() == [True, False, False, True, True, True]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DIR)


@pytest.fixture(scope="module")
def model(docs):
    return L.train(docs.filter(~L.fold()))


def test_held_out_accuracy(docs, model):
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and len(rows) > 150
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_by_hand(model):
    langs, logs = model
    for text in ("the and", "Über die", "x"):
        buckets, begins, _ = L.ngrams([text])
        total = logs[-1].astype(float) + sum(logs[b].astype(float).sum(axis=0) for b in buckets)
        p = np.exp(total - total.max())
        (pred,), (score,) = L.scores([text], *model)
        assert pred == langs[int(total.argmax())] and math.isclose(score, p.max() / p.sum(), rel_tol=1e-9)


def test_odd_rows(spark, odd_docs, no_docs, model):
    rows = L.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (3, 4, 5)] == [("und", 0.0)] * 3 and by[8].lang_pred != "und" and by[None].held_out
    kept = L.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (3, 4, 5)").count() == 0 and kept.filter("doc_id in (1, 8, 10, 12)").count() == 5
    assert L.identify(no_docs, L.train(no_docs)).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, L.train(no_docs)).collect()} == {"und"}


def test_training_bound(docs):
    langs, logs = L.train(docs, max_docs=100)
    assert len(langs) == 4 and logs.shape == ((1 << L.BITS) + 1, 4)


def test_counts_by_definition(spark):
    """Log-probabilities from n-grams counted one by one."""
    rows = [("en", "The cat, the hat"), ("en", "thé cat"), ("fr", "Le chat est là"), ("fr", None), (None, "not read"), ("de", "!!")]
    langs, logs = L.train(spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert langs == ["en", "fr"]  # of the third no letter was seen
    want, docs = np.zeros((1 << L.BITS, 2)), np.zeros(2)
    for g, t in rows:
        if g in langs and t:
            buckets, _, some = L.ngrams([t])
            docs[langs.index(g)] += some[0]
            for b in buckets:
                for x in b.tolist():
                    want[x, langs.index(g)] += 1
    smooth = np.log(want + L.SMOOTHING) - np.log(want.sum(axis=0) + L.SMOOTHING * (1 << L.BITS))
    assert np.allclose(logs[:-1], smooth, atol=1e-5) and np.allclose(logs[-1], np.log((docs + 1) / (docs + 1).sum()), atol=1e-5)
