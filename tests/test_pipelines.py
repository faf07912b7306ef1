from focalis.operators import mining, reshape
from focalis.plans import pipelines
from focalis.sources import readers

ROWS = [(i, f"{w} {v} the {n}{p}", n) for i, (w, v, n, p) in enumerate([("What", "named", "river", "?"), ("Which", "called", "city", "?"), ("What", "named", "lake", "?"), ("Who", "walked", "dog", "."), ("What", "named", "sea", "?")], 1)]


def test_questions_to_accuracy(spark, tmp_path):
    q = spark.createDataFrame(ROWS, readers.QUESTION)
    long = pipelines.training_long(q)
    wide = {r.sent_id: r for r in pipelines.training_wide(q).collect()}
    assert wide[1].SENTENCE_PATTERN == "疑问句" and wide[4].SENTENCE_PATTERN == "陈述句" and wide[2].QUESTION_WORD == "city" and wide[1].DEPENDENCY_PATH.count("-->") >= 3
    pipelines.write_cleaned(pipelines.cleaned_queries(q), f"{tmp_path}/c")
    cleaned = readers.parse_cleaned(spark.read.text(f"{tmp_path}/c"))
    assert cleaned.count() == len(ROWS)
    gold = q.selectExpr("id as sent_id", "question_word as word")
    rows = pipelines.experiment(long, cleaned, gold, 0, 0.1, 6).orderBy("k").collect()
    assert [r.total for r in rows] == [5] * 6 and rows[5].correct >= rows[0].correct and rows[5].correct >= 1
    text = pipelines.tree_text(mining.rule_counts(reshape.from_long(long, "sent_id")))
    assert "QUESTION_WORD=river" in text


def test_parity_forms(spark):
    q = spark.createDataFrame(ROWS[:1], readers.QUESTION)
    floats = {r.value for r in pipelines.training_long(q, float_positions=True).filter("name rlike '_[0-9]+$'").collect()}
    assert floats <= {"1.0", "2.0"} and floats
    nested = pipelines.cleaned_queries(q, nested_keys=True)
    plain = pipelines.cleaned_queries(q)
    a, b = (sum(k.startswith("((") for k in x.first().words) for x in (nested, plain))
    assert a >= b == 0


def test_query_words_by_path(spark):
    """Each path of the training side leads a query to its word; ``how many`` in small letters starts at ``how``."""
    rows = [*ROWS, (6, "In how many of the rivers?", "rivers")]
    q = spark.createDataFrame(rows, readers.QUESTION)
    trained = {(r.sent_id, f"('DEPENDENCY_PATH', '{r.value}')") for r in pipelines.training_long(q).filter("name = 'DEPENDENCY_PATH'").collect()}
    assert {i for i, _ in trained} == {r[0] for r in rows}
    words = {r.id: r.words for r in pipelines.cleaned_queries(q).collect()}
    gold = {r[0]: r[2] for r in rows}
    assert all(gold[i] in words[i].get(key, []) for i, key in trained)
    assert sum("DEPENDENCY_PATH" in key for key in words[1]) == 3
