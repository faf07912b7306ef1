from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from focalis.llm import decontaminate as D
from focalis.llm.words import words

from invented import inside, sentence


def test_masks_leave_one_seed_for_any_two_substitutions():
    for gone in combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(all(o + i not in gone for i, c in enumerate(m) if c == "1") for m in D.MASKS for o in range(D.WINDOW - len(m) + 1))


def brute(text, item):
    """All alignments, by definition."""
    a, b = (words(pa.array([x]))[0].tolist() for x in (text, item))
    if not b:
        return False
    n = min(D.WINDOW, len(b))
    most = D.SUBSTITUTIONS * n // D.WINDOW if n >= D.SHORTEST else 0
    return any(sum(a[i + k] != b[j + k] for k in range(n)) <= most for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, sentence(3050, 30)), (2, sentence(3051, 9)), (3, "too short"), (4, None), (None, sentence(3052, 20)), (5, sentence(3050, 30)), (6, "")]
    return spark.createDataFrame(items, "item_id long, text string")


def changed(k, n, *places):
    w = sentence(k, n).split()
    for p in places:
        w[p] = "other"
    return " ".join(w)


CASES = [
    sentence(3090) + " " + sentence(3050, 30).upper() + ". " + sentence(3091),
    sentence(3090) + " " + changed(3050, 30, 3, 9, 15, 21, 27),
    " ".join(sentence(3050, 30).split()[8:21]),
    " ".join(sentence(3050, 30).split()[8:20]),
    changed(3050, 30, 1, 4, 7, 10, 13, 16, 19, 22, 25, 28),
    sentence(3051, 9),
    changed(3051, 9, 4),
    changed(3051, 9, 4, 5),
    "Too  short!",
    sentence(3052, 20) + "!",
    sentence(3092),
    "too few, short",
]


def test_same_as_all_alignments(spark, bench):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    items = [r.text for r in bench.collect() if r.text]
    want = {i for i, t in enumerate(CASES) if any(brute(t, x) for x in items)}
    assert {0, 1, 2, 5, 8, 9} <= want and not {3, 4, 10, 11} & want
    rows = {r.doc_id: r for r in D.leak_report(docs, bench).collect()}
    assert len(rows) == len(CASES) and {i for i, r in rows.items() if r.contaminated} == want
    assert rows[0].item_ids == [1, 5] and rows[0].best_overlap == 30 and rows[10].item_ids == []
    assert {r.doc_id for r in D.remove_leaks(docs, bench).collect()} == set(range(len(CASES))) - want


def test_parts_of_the_benchmark_do_not_matter(spark, bench, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    whole = sorted(map(str, D.leak_report(docs, bench).collect()))
    made = D.indexes
    monkeypatch.setattr(D, "indexes", lambda b: made(b, part_words=40))
    assert len(D.indexes(bench)) > 2
    assert sorted(map(str, D.leak_report(docs, bench).collect())) == whole


def test_odd_rows(spark, odd_docs, no_docs, bench):
    report = D.leak_report(odd_docs, bench)
    assert report.count() == odd_docs.count() and report.filter("contaminated or contaminated is null").count() == 0
    assert inside(D.remove_leaks(odd_docs, bench), odd_docs) and D.remove_leaks(odd_docs, bench).count() == odd_docs.count()
    assert D.leak_report(no_docs, bench).count() == 0 and D.remove_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_joins_find_the_same(spark, bench, odd_docs, no_docs):
    """A benchmark too large to be handed out: seeds are joined."""
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumn("_n", F.lit("a name")).repartition(3)
    few = sorted(map(str, D.leak_report(docs, bench).collect()))
    assert sorted(map(str, D.leak_report(docs, bench, broadcast_words=0).collect())) == few
    kept = D.remove_leaks(docs, bench, broadcast_words=0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, D.remove_leaks(docs, bench).collect()))
    assert D.remove_leaks(odd_docs, bench, broadcast_words=0).count() == odd_docs.count() and D.remove_leaks(no_docs, bench, broadcast_words=0).count() == 0


def test_seeds_are_not_broadcast(spark, bench, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    plans, made = {}, D.written

    def seen(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return made(df, what)

    monkeypatch.setattr(D, "written", seen)
    D.leak_report(docs, bench, broadcast_words=0)
    assert "SortMergeJoin" in plans["seed-hits"] and "Broadcast" not in plans["seed-hits"]


def test_every_length_and_place():
    """Items of 1 to 13 words, whole and with each one and each two words changed, alone and within other text, against all alignments."""
    for n in range(1, 14):
        item = sentence(3070 + n, n)
        index = D.Index([1], [item])
        texts = [item, f"before {item} after"]
        for k in (1, 2):
            texts += [f"x {changed(3070 + n, n, *gone)} y" for gone in combinations(range(n), k)]
        rows, at = words(pa.array(texts))
        assert set(index.leaks(rows, at)) == {i for i, t in enumerate(texts) if brute(t, item)}, n


def test_hits_in_bounded_memory(monkeypatch):
    items = [sentence(3100, 6) + " " + sentence(3200 + k, 10) for k in range(30)]
    docs = [" ".join(items[::2]), items[3] * 2, sentence(1)]
    rows, at = words(pa.array(docs))
    index = D.Index(list(range(30)), items)
    whole = index.leaks(rows, at)
    monkeypatch.setattr(D, "HITS", 3)
    assert index.leaks(rows, at) == whole and len(whole[0]) == 15


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12])
def test_short_items_allow_one_substitution_anywhere(n):
    item = sentence(3060, n).split()
    index = D.Index([1], [" ".join(item)])
    texts = [" ".join(["before", *item[:k], "other", *item[k + 1 :], "after"]) for k in range(n)] + [" ".join(["x", *item[1:-1], "y"])]
    rows, at = words(pa.array(texts))
    assert index.leaks(rows, at) == {k: {0: n - 1} for k in range(n)}
