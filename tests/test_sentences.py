"""Features of gathered sentences: what is shuffled, and repeated or odd ids and tokens."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from focalis.operators import features, paths

SF = "/root/testdata/sf0.001"
SHUFFLES = {"query_candidates": 2, "training_features": 2, "path_graph": 1, "shortest_paths": 1, "all_target_paths": 1, "edge_positions": 1, "direct_dependency": 1}


@pytest.mark.parametrize("name", SHUFFLES)
def test_only_texts_are_shuffled(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == SHUFFLES[name] and "Join" not in plan and "Aggregate" not in plan


def conversations(folder, rows):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, (a, b, "user", t))) for a, b, t in rows], schema), f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SHUFFLES)
def test_odd_ids_and_texts(spark, tmp_path, name):
    long = "".join(f"Ab{i} cd ab{i}." for i in range(10_002))
    for rows in ([], [(1, 0, None), (2, 0, ""), (3, 0, "... !"), (None, 0, "a b c a."), (4, None, "Xy z xy.")], [(1, 0, long), (1, 1, "How many the the? Ran to X1. 7 8")]):
        folder = conversations(tmp_path, rows)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
        if len(rows) == 2:  # sentences of both turns have the same id: SQL has no order for their tokens
            assert not entry.queries()[name](spark, folder).isEmpty()
            continue
        df = entry.queries()[name](spark, folder)
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_tokens_with_gaps_repeats_and_parts(spark):
    rows = [
        (0, 1, 1, "A", "a", "NN", 2, "x"), (0, 1, 2, "b", "b", "VB", 0, "y"), (0, 2, 1, "C", "c", "NN", 0, "x"), (0, 2, 2, "d", "d", "NN", 1, "x"),
        (1, 1, 3, "p", "p", "NN", 7, "x"), (1, 1, 7, "q", "q", "NN", 4, None),
        (2, 1, 1, "m", "m", "NN", 0, "x"), (2, 1, 1, "n", "n", "NN", 0, "x"), (2, 1, 2, "o", "o", "NN", 1, "x"),
    ]
    found = {}
    for r in features.edges(spark.createDataFrame(rows[::-1], features.TOKENS)).collect():
        found.setdefault(r.sent_id, []).append((r.ord, r.rel, r["head"], r.dep))
    assert sorted(found[0]) == [(1, "x_0", "b", "A"), (2, "y_0", "b", "b"), (3, "x_1", "C", "C"), (4, "x_2", "C", "d")]
    assert sorted(found[1]) == [(1, "x_0", "q", "p"), (2, None, "q", "q")]
    assert sorted(found[2]) == [(1, "x_0", "m", "m"), (2, "x_1", "n", "n"), (3, "x_2", "m", "o"), (3, "x_2", "n", "o")]


def test_gathered_sentences_are_as_tables_of_tokens(spark):
    s = spark.createDataFrame([(0, "How many cats see the cats?"), (1, "Then he ran. he"), (1, "who ran"), (2, "7 8"), (3, "Xa Xa xa")], "sent_id long, text string")
    gold = spark.createDataFrame([(0, "CATS"), (1, "ran"), (2, "9")], "sent_id long, word string")
    t, g = features.rule_tokens(s), features.rule_sentences(s, True)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(features.structure_word(t)) == text(features.structure_word(g)) and text(features.edges(t)) == text(features.edges(g))
    assert text(features.query_table(s, t, paths.from_structure_word(s, t))[1]) == text(features.query_table(None, g, paths.from_structure_word(None, g))[1])
    pairs = spark.createDataFrame([(1, "who", None)], "sent_id long, source string, target string")
    walked = paths.shortest_paths(features.edges(t), pairs).select("sent_id", F.col("target").alias("word"), "path")
    assert text(walked) == text(paths.from_structure_word(None, g).filter("sent_id = 1").drop("pos")) and walked.count() > 0
    table = {(r.sent_id, r.name, r.value) for r in features.training_table(s, t, gold).collect()}
    assert (0, "QUESTION_WORD", "cats") in table and (1, "QUESTION_WORD", "ran") in table and not any(i == 2 and n.startswith("QUESTION") for i, n, _ in table)
