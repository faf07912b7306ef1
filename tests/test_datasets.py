import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from focalis.operators import datasets

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("table, order", [("orders", ["o_orderdate", "o_orderkey"]), ("documents", ["source", "doc_id"])])
def test_numbers_of_whole_wide_tables(spark, table, order):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    got = datasets.numbered(df.withColumn("_part", df[order[1]]).withColumn("_place", df[order[1]]), order).toPandas()
    want = df.select(*order).toPandas().sort_values(order, kind="stable").reset_index(drop=True)
    got = got.sort_values("row_idx").reset_index(drop=True)
    assert got.row_idx.tolist() == list(range(len(want))) and got[order].equals(want)
    assert (got["_part"] == got[order[1]]).all() and (got["_place"] == got[order[1]]).all()


def test_numbers_of_ties_nulls_and_nothing(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (1, "c"), (None, None)]
    got = datasets.numbered(spark.createDataFrame(rows, "k int, v string"), ["k"]).collect()
    assert sorted(r.row_idx for r in got) == list(range(5)) and {r.k for r in got if r.row_idx < 2} == {None}
    assert datasets.numbered(spark.createDataFrame([], "k int"), ["k"]).collect() == []


def test_keyed_subset_gives_rows_in_order(spark):
    full = spark.createDataFrame([(0, "k1", "x"), (1, "k2", "y"), (2, "k1", "z"), (3, None, "n")], "row_idx long, k string, _last string")
    part = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,), ("none",)], "k string")
    got = [tuple(r) for r in datasets.keyed_subset(full, part, ["k"]).collect()]
    assert got == [(1, "k2", "y"), (1, "k2", "y"), (2, "k1", "z")]


def test_equality_in_order(spark):
    schema = "row_idx long, a int, b double"
    a = spark.createDataFrame([(0, 1, 1.0), (1, None, float("nan")), (2, 3, 3.0)], schema)
    assert datasets.equal(a, a, "row_idx")
    b = spark.createDataFrame([(0, None, float("nan")), (1, 1, 1.0), (2, 3, 3.0)], schema)
    assert not datasets.equal(a, b, "row_idx") and datasets.equal(a.drop("row_idx"), b.drop("row_idx"))
    assert [(r.row, r["columns"]) for r in datasets.differences_in_order(a, b).orderBy("row").collect()] == [(0, ["a", "b"]), (1, ["a", "b"])]
    assert [r.row for r in datasets.differences_in_order(a, a.limit(2)).collect()] == [2]


def test_sample(spark):
    df = spark.range(1000)
    one, two = (datasets.sample_fixed(df.repartition(k), 20, seed=3).collect() for k in (2, 7))
    assert sorted(one) == sorted(two) and len(set(one)) == 20 and sorted(one) != sorted(datasets.sample_fixed(df, 20, seed=4).collect())


def test_queries_without_the_corpus_part(tmp_path):
    """With its folders gone and the pipeline left in place, the other queries are there."""
    for name in ("focalis", "__spark_entry__.py", "corpus_pipeline.py"):
        there = ROOT / name
        if there.is_dir():
            shutil.copytree(there, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif there.exists():
            shutil.copy(there, tmp_path / name)
    code = "import __spark_entry__ as e; from focalis import catalog as c; assert list(e.queries()) == list(c.QUERIES) and e.oracle_sql() == c.ORACLE_SQL"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
