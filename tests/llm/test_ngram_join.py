from random import Random

import numpy as np
import pyarrow as pa
import pytest

from focalis.llm import ngram_join as J

from invented import inside, sentence


def brute(texts, similarity=0.8):
    """Links of each text and its class, from all pairs."""
    flat, at = J.sets_of(pa.array(texts, pa.string()))
    sets = [set(flat[p:q].tolist()) for p, q in zip(at, at[1:])]
    n, label = [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return n, label


def corpus():
    r, out = Random(8), []
    shared = sentence(999, 60)
    for k in range(60):
        base = sentence(k, r.randint(3, 120))
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 6])):
            w = base.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["new", "other", "word"])
            out.append(" ".join(w).title() + "." * r.randint(0, 1))
        if k % 3 == 0:
            out.append(shared + " " + sentence(1000 + k, 80))
    out += [sentence(5000, 200).replace("w", "w", 1) + f" tail{i}" for i in range(90)]  # one group of near copies, larger than a leaf
    return out + [None, "", "!!", "one", "One."]


def test_join_equals_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    n, label = brute(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join_documents(docs).collect()}
    assert got == {i: (label[i], n[i]) for i in range(len(texts))}
    assert {r.doc_id for r in J.keep_one(docs).collect()} == set(label)


def test_large_ids(spark):
    ids = [2**62, 2**62 + 5, 2**63 - 1, -(2**63), None, 0]
    docs = spark.createDataFrame([(i, sentence(1) if k < 4 else sentence(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join_documents(docs).collect()}
    assert set(got) == set(ids) and all(got[i] == (-(2**63), 3) for i in ids[:4]) and got[0] == (0, 0)


def test_recall_on_a_whole_table(spark, capsys):
    """Links of the test table against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    n, label = brute([r.text for r in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join_documents(docs).collect()}
    found, true = sum(got[r.doc_id][1] for r in rows), sum(n)
    with capsys.disabled():
        print(f"\nn-gram join at sf0.01: {found} of {true} links at {J.SIMILARITY}, recall {found / true:.4f}")
    assert 0.995 * true <= found <= true and all(got[r.doc_id][1] <= k for r, k in zip(rows, n))
    assert sum(got[r.doc_id][0] == rows[k].doc_id for r, k in zip(rows, label)) >= 0.995 * len(rows)


@pytest.mark.parametrize("block, shingles", [(8, 1 << 20), (2048, 300)])
def test_blocks_and_tiles_do_not_matter(spark, monkeypatch, block, shingles):
    texts = corpus()[-120:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, J.join_documents(docs).collect()))
    for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("TILE", 5), ("CELLS", 64)):
        monkeypatch.setattr(J, name, value)
    assert sorted(map(tuple, J.join_documents(docs).collect())) == whole


def test_intermediate_tables_go(spark):
    from focalis import store

    folder = store.shared_dir(spark)
    before = set(store.names_in(spark, folder))
    J.keep_one(spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")).collect()
    assert {n.rpartition("-")[0] for n in set(store.names_in(spark, folder)) - before} == {"kept"}


def test_blocks_count_each_pair_once():
    r = np.random.default_rng(2)
    base = np.sort(r.integers(0, 2**63, 100).astype(np.uint64))
    rows = []
    for i in range(70):
        s = np.unique(np.concatenate((base[: 100 - i % 9], r.integers(0, 2**63, i % 7).astype(np.uint64))))
        rows.append((i.to_bytes(16, "big"), 1 + i % 2, [5, 9] if i % 3 else [3, 5], s.tobytes()))
    def ok(a, b):
        x, y = (set(np.frombuffer(q[3], np.uint64).tolist()) for q in (a, b))
        return len(x & y) * 10 >= len(x | y) * 8
    want = {a[0]: sum(b[1] for b in rows if b is not a and ok(a, b)) for a in rows}
    got, roots = dict.fromkeys(want, 0), set()
    for leaf in (3, 5, 9):  # each leaf in two blocks
        own = [q for q in rows if leaf in q[2]]
        left, right = own[::2], own[1::2]
        for a, b in ((left, None), (right, None), (left, right)):
            for key, n, root in J.links_in(leaf, a, b, 0.8):
                got[key] += n
                roots.add(root)
    assert got == want and roots


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_paths(similarity):
    """Pairs at the threshold share a node at the greatest depth as often as promised."""
    r, runs, hit, tries = np.random.default_rng(4), J.runs_for(similarity, 0.99), 0, 400
    for _ in range(tries):
        shared, own = int(200 * similarity), int(100 * (1 - similarity))
        common = r.integers(0, 2**63, shared).astype(np.uint64)
        pair = [np.unique(np.concatenate((common, r.integers(0, 2**63, own).astype(np.uint64)))) for _ in range(2)]
        at = np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])
        p = J.paths_of(np.concatenate(pair), at, runs)
        hit += (p[0, :, -1] == p[1, :, -1]).any()
    assert hit >= 0.975 * tries


def test_runs_miss_independently():
    """Of pairs at the threshold, no more are missed at the greatest depth than the stated recall allows."""
    r, tries = np.random.default_rng(11), 8000
    sets = []
    for _ in range(tries):
        common = r.integers(0, 2**63, 80).astype(np.uint64)
        sets += [np.unique(np.concatenate((common, r.integers(0, 2**63, 10).astype(np.uint64)))) for _ in range(2)]
    p = J.paths_of(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), J.runs_for(J.SIMILARITY, J.RECALL))
    missed = tries - (p[::2, :, -1] == p[1::2, :, -1]).any(axis=1).sum()
    assert missed <= 16  # 8 are expected; shared functions would miss 49


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    key = lambda i: (i * 2654435761 % 2**32).to_bytes(16, "big")
    got = {bytes(r.u): bytes(r.p) for r in J.components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "u binary, v binary")).collect()}
    groups = [range(41), (100, 101, 103)]
    assert got == {key(i): min(map(key, g)) for g in groups for i in g}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = J.join_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert by[1] == [(1, 3)] and by[10] == [(1, 3)] * 2 and (1, 3) in by[None]
    assert by[3] == [(3, 0)] and by[5] == [(5, 0)] and by[6] == [(6, 1)] and by[7] == [(6, 1)] and by[12] == [(8, 1)]
    kept = J.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and inside(kept, odd_docs)
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 11, 13]
    assert kept.filter("doc_id is null").count() == 2
    assert J.join_documents(no_docs).count() == 0 and J.keep_one(no_docs).count() == 0
