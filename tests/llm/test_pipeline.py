import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (ROOT / "corpus_pipeline.py").exists(), reason="no pipeline")


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, str(ROOT))
    import corpus_pipeline

    return corpus_pipeline


def test_stages_keep_columns(spark, pipeline, odd_docs, no_docs):
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, odd_docs, SF), stage(spark, no_docs, SF)
        assert none.count() == 0
        if name != "packing":
            assert out.dtypes == odd_docs.dtypes and 0 < out.count() <= odd_docs.count()


def test_run_equals_stages_by_brute_force(spark, pipeline):
    import pyarrow as pa
    from focalis.llm import decontaminate, langid, ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = langid.train(docs.filter(~langid.fold()))
    pred, score = langid.scores([r.text for r in rows], *model)
    rows = [r for r, p, s in zip(rows, pred, score) if p != "und" and s >= 0.5]
    flat, at = ngram_join.sets_of(pa.array([r.text for r in rows]))
    sets = [set(flat[p:q].tolist()) for p, q in zip(at, at[1:])]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    rows = [rows[i] for i in sorted(set(label))]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = decontaminate.Index([b.item_id for b in bench], [b.text for b in bench])
    rows = [r for r in rows if not index.leaks(*decontaminate.words(pa.array([r.text])))]
    pieces = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
    used = {}
    for p in pieces:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    assert max(used.values()) <= 1024 and sum(used.values()) >= 0.97 * 1024 * len(used)
