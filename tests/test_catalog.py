"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.10g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted([tuple(shown(r[i]) for i in order) for r in found.fetchall()], key=str)
    assert sorted([tuple(shown(r[columns[i]]) for i in order) for r in df.collect()], key=str) == want


@pytest.mark.parametrize("name", ["timing_sweep"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_feature_queries_have_paths(spark):
    for name in ("query_candidates", "training_features"):
        assert not entry.queries()[name](spark, SF).filter("name = 'DEPENDENCY_PATH'").isEmpty()


def test_nothing_stays_cached(spark):
    entry.queries()["rules_flagship"](spark, SF).collect()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
