"""Sentence features, paths, sources and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from focalis.functions import text as T
from focalis.operators import features, mining, paths
from focalis.plans.registry import Experiment, Registry
from focalis.sources import readers, writers
from focalis.streaming import scoring


def tokens(spark, *sentences):
    rows = []
    for i, s in enumerate(sentences):
        for k, w in enumerate(s.split(), 1):
            word, xpos, *more = w.split("/")
            rows.append((i, 1, k, word, word.lower(), xpos, int(more[0]) if more else k - 1, more[1] if len(more) > 1 else "dep"))
    return spark.createDataFrame(rows, features.TOKENS)


@pytest.mark.parametrize(
    "sentence,word",
    [("Name/VB the/DT river/NN", "Name"), ("How/WRB many/JJ rivers/NNS", "How many"), ("In/IN which/WDT city/NN", "which"), ("He/PRP lives/VBZ here/RB", "lives"), ("The/DT red/JJ house/NN", "red"), ("X/NN", None)],
)
def test_structure_word(spark, sentence, word):
    assert features.structure_word(tokens(spark, sentence)).first().word == word


def test_strict_structure_word_fails(spark):
    with pytest.raises(Exception, match="no structure word"):
        features.structure_word(tokens(spark, "X/NN"), strict=True).collect()


def test_numbering_and_positions(spark):
    t = tokens(spark, "the/DT/2/det dog/NN/0/nsubj a/DT/2/det")
    e = features.edges(t)
    assert [(r.rel, r["head"], r.dep) for r in e.orderBy("ord").collect()] == [("det_0", "dog", "the"), ("nsubj_0", "dog", "dog"), ("det_1", "dog", "a")]
    word = spark.createDataFrame([(0, "the")], "sent_id long, word string")
    assert [(r.name, r.value) for r in features.edge_positions(e, word, "SENTENCE_").collect()] == [("SENTENCE_DET_0", "2")]
    pairs = spark.createDataFrame([(0, "dog", "the"), (0, "dog", "dog")], "sent_id long, s string, q string")
    assert sorted((r.q, r.value) for r in features.direct_dependency(e, pairs).collect()) == [("dog", "NSUBJ_0_1"), ("dog", "NSUBJ_0_2"), ("the", "DET_0_2")]


def test_paths():
    e = [("cop_0", "is", "What"), ("nsubj_0", "is", "peak"), ("det_0", "peak", "the"), ("root_0", "is", "is")]
    assert paths.shortest(e, "What", "peak") == {"peak": ["[cop_0：<--] --> [nsubj_0：-->]"]}
    assert paths.shortest(e, "What", "the") == {"the": ["[cop_0：<--] --> [nsubj_0：-->] --> [det_0：-->]"]}
    assert paths.shortest(e, "What", "What") == {} and paths.shortest(e, "What", "none") == {}
    both = [("a_0", "x", "y"), ("b_0", "x", "y")]
    assert paths.shortest(both, "x") == {"y": ["[a_0：-->]", "[b_0：-->]"]}


def test_paths_on_tables(spark):
    t = tokens(spark, "What/WP/2/cop is/VBZ/0/root peak/NN/2/nsubj")
    pairs = spark.createDataFrame([(0, "What", None)], "sent_id long, source string, target string")
    got = {(r.target, r.path) for r in paths.shortest_paths(features.edges(t), pairs).collect()}
    assert got == {("is", "[cop_0：<--]"), ("peak", "[cop_0：<--] --> [nsubj_0：-->]")}


def test_text(spark):
    rows = [("  Who is it? ", "陈述句", "Who is it"), ("Who?", "疑问句", "Who"), ("A..", "陈述句", "A."), ("", "陈述句", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(T.sentence_pattern(F.col("t")), T.stripped(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
    words = spark.createDataFrame([("The C++ book", "c++ b"), ("Über uns", "über"), ("cats", "cat")], "t string, w string")
    assert [r[0] for r in words.select(T.contains_word(F.col("t"), F.col("w"))).collect()] == [False, True, False]


def test_training_and_query_tables_agree(spark):
    s = spark.createDataFrame([(0, "What is peak?")], "sent_id long, text string")
    t = tokens(spark, "What/WP/2/cop is/VBZ/0/root peak/NN/2/nsubj")
    gold = spark.createDataFrame([(0, "peak")], "sent_id long, word string")
    train = {(r.name, r.value) for r in features.training_table(s, t, gold).collect()}
    assert {("SENTENCE_PATTERN", "疑问句"), ("SENTENCE_STRUCTURE_WORD", "What"), ("SENTENCE_COP_0", "2"), ("QUESTION_WORD", "peak"), ("QUESTION_WORD_POS", "NN"), ("QUESTION_NSUBJ_0", "2")} == train - {("SENTENCE_STRUCTURE_WORD_POS", "WP")}
    c, cand = features.query_table(s, t)
    assert {tuple(x) for x in c.first().c} == {x for x in train if x[0].startswith("SENTENCE")}
    assert {tuple(r.item) for r in cand.filter("word = 'peak'").collect()} == {x for x in train if x[0].startswith("QUESTION")}


def test_repeated_word_keeps_its_tags(spark):
    s = spark.createDataFrame([(0, "Who can can?")], "sent_id long, text string")
    _, cand = features.query_table(s, tokens(spark, "Who/WP can/MD can/VB"))
    rows = [(tuple(r.item), r.word, r.pos.idx) for r in cand.filter("word = 'can' and item.name in ('QUESTION_WORD', 'QUESTION_WORD_POS')").collect()]
    assert sorted(rows) == [(("QUESTION_WORD", "can"), "can", 2), (("QUESTION_WORD_POS", "MD"), "can", 2), (("QUESTION_WORD_POS", "VB"), "can", 2)]


def test_cleaned_json(spark, tmp_path):
    entries = [{"id": 1, "data": {"set": ["a", "b", "a"], "dict": {"x": ["w"]}}}, {"id": 2}, {"id": 3, "data": {"set": "no", "dict": 5}}, 7]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    got = {r.id: (r["items"], r.words) for r in readers.read_cleaned(spark, str(tmp_path / "c.json")).collect()}
    assert got == {1: (["a", "b"], {"x": ["w"]}), 3: ([], {})}
    (tmp_path / "bad.json").write_text("[{")
    assert readers.read_cleaned(spark, str(tmp_path / "bad.json")).count() == 0


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "it's <x> & ö"), (None, "b", "")], "a string, b string, c string")
    for ending in ("parquet", "csv", "xlsx"):
        writers.write_table(df, f"{tmp_path}/t.{ending}")
        back = readers.read_table(spark, f"{tmp_path}/t.{ending}")
        want = [("1", None, "it's <x> & ö"), (None, "b", "")]
        assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, want)) or ending == "csv"
    q = [{"id": 5, "sentence": "Who?", "question_word": "Who"}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    assert readers.read_questions(spark, str(tmp_path / "q.json")).first().asDict() == q[0]
    assert [r.id for r in writers.renumbered(df, ["a"]).orderBy("id").collect()] == [1, 2]
    for i in (2, 10):
        df.write.parquet(f"{tmp_path}/shards/train-data-{i}.parquet")
    assert writers.processed_path("a/b.json") == "a/b_processed.json"
    assert writers.stamped_path("r.xlsx", datetime(2024, 1, 2, 3, 4, 5)) == "r_20240102_030405.xlsx"


def test_registry():
    r = Registry()
    r.register("x", Experiment)
    assert r.get("x") is Experiment
    with pytest.raises(ValueError):
        r.get("y")


def test_streaming(spark, tmp_path):
    schema = "tid long, c array<struct<name:string,value:string>>, d array<struct<name:string,value:string>>"
    rows = [(i, [("A", "x" if i % 2 else "y"), ("B", "z")], [("Q", "1" if i % 3 else "2")]) for i in range(12)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    counts = scoring.IncrementalCounts(f"{tmp_path}/counts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(counts.add).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    whole = mining.rule_counts(spark.createDataFrame(rows, schema))
    assert sorted(map(str, counts.current(whole).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    rules = mining.rules(whole, 1, 0.1)
    q = scoring.score_stream(stream.select("tid", "c"), rules, 1).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.best[0].decision.value for r in spark.table("scored").collect()} == {"1"}
