"""Hand-computed cases and properties of mining, lookup and evaluation."""

from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from focalis import catalog
from focalis.functions import items as I
from focalis.operators import datasets, evaluate, lookup, mining, reshape
from focalis.plans import sweep

TX = "tid long, c array<struct<name:string,value:string>>, d array<struct<name:string,value:string>>"


def tx(spark, rows):
    pair = lambda s: tuple(s.split("="))
    return spark.createDataFrame([(i, sorted(map(pair, c)), sorted(map(pair, d))) for i, (c, d) in enumerate(rows, 1)], TX)


@pytest.fixture(scope="module")
def m1(spark):
    c = ["C1=x", "C2=x", "C3=x"]
    return tx(spark, [([*c, "C4=x"], ["Q=1"]), (c, ["Q=1"]), (c, ["Q=2"])])


@pytest.mark.parametrize("support,confidence,n", [(1, 0.5, 7), (2, 0.5, 0), (0, 0.5, 15), (0, 0.3, 22), (0, 1.0, 0)])
def test_mining_by_hand(m1, support, confidence, n):
    assert mining.mine_rules(m1, support, confidence).count() == n


def brute(rows, support, confidence):
    n_a, n_ad = {}, {}
    for c, d in rows:
        for k in range(1, len(c) + 1):
            for a in combinations(sorted(set(c)), k):
                n_a[a] = n_a.get(a, 0) + 1
                for x in set(d):
                    n_ad[a, x] = n_ad.get((a, x), 0) + 1
    return {(a, x, n, n_a[a]) for (a, x), n in n_ad.items() if n > support and n_a[a] > support and n / n_a[a] > confidence}


def found(rules):
    return {(tuple(f"{x.name}={x.value}" for x in r.antecedent), f"{r.decision.name}={r.decision.value}", r.n_ad, r.n_a) for r in rules.collect()}


@pytest.mark.parametrize("n", [0, 1, 4, mining.LISTED, mining.LISTED + 1, mining.LISTED + 2])
def test_subsets_in_mask_order(spark, n):
    df = spark.createDataFrame([([(f"C{i:02d}", "x") for i in range(n)], 7)], TX.split(", ")[1] + ", _late int")
    got = [(tuple(x.name for x in r.antecedent), r._late) for r in mining.with_subsets(df).collect()]
    assert got == [(tuple(f"C{i:02d}" for i in range(n) if m >> i & 1), 7) for m in range(1, 1 << n)]


def test_wide_sets(spark):
    many = [f"C{i:02d}=x" for i in range(16)]
    t = tx(spark, [(many, ["Q=1"])] * 3)
    found = mining.rule_counts(t).agg(F.count("*").alias("n"), F.sum(F.size("antecedent")).alias("items"), F.min("n_ad").alias("least")).first()
    assert found == (2**16 - 1, 16 * 2**15, 3)
    with pytest.raises(Exception, match="more than 32 items"):
        mining.itemset_counts(tx(spark, [([f"C{i:02d}=x" for i in range(33)], ["Q=1"])])).count()


def test_counts_are_made_in_one_pass(m1):
    """Spark's estimate of subsets is that of their rows before, so no join may rest on it."""
    plan = mining.rule_counts(m1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 3


def test_weights_beside_a_column_of_that_name(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "_w string, q int")
    rows = reshape.weighted_transactions(df, ["_w", "q"], ["q"]).collect()
    assert sorted((r.c[0].value, r.d[0].value, r.w) for r in rows) == [("a", "1", 2), ("b", "2", 1)]


def test_mining_equals_brute_force_and_fpgrowth(spark):
    r = Random(4)
    rows = [([f"{n}={r.choice('uv')}" for n in "ABCD"[: r.randint(1, 4)]], [f"Q={r.choice('xyz')}"] + ["P=1"] * (r.random() < 0.5)) for _ in range(60)]
    t = tx(spark, rows)
    assert found(mining.mine_rules(t, 3, 0.4)) == brute(rows, 3, 0.4)
    assert {x[:2] for x in found(mining.mine_rules(t, 3, 0.4))} == {(tuple(f"{x.name}={x.value}" for x in r.antecedent), f"{r.decision.name}={r.decision.value}") for r in mining.mine_with_fpgrowth(t, 3, 0.4).collect()}
    halves = [tx(spark, rows[:25]), tx(spark, rows[25:])]
    merged = mining.merged_counts(*map(mining.rule_counts, halves))
    assert found(mining.rules(merged, 3, 0.4)) == brute(rows, 3, 0.4)
    counts = mining.rule_counts(t, 2)
    grid = [(2, 0.2), (3, 0.4), (5, 0.1)]
    for i, (s, c) in enumerate(grid, 1):
        assert found(sweep.swept_rules(counts, grid).filter(F.col("experiment_id") == i)) == brute(rows, s, c)


def test_empty_sides_fail(spark):
    for rows in ([([], ["Q=1"])], [(["A=1"], [])]):
        with pytest.raises(Exception, match="no (condition|decision) item"):
            mining.mine_rules(tx(spark, rows), 0, 0.1).collect()


def rules_table(spark, rows):
    return spark.createDataFrame([([("", x) for x in a], ("", d), c, s) for a, d, c, s in rows], "antecedent array<struct<name:string,value:string>>, decision struct<name:string,value:string>, confidence double, support double")


def test_ranking_ties_and_distinct_words(spark):
    rules = rules_table(spark, [(["a"], "x", 0.5, 0.2), (["a", "b"], "y", 0.4, 0.25), (["c"], "z", 0.9, 0.9)])
    s = spark.createDataFrame([(1, [("", "a"), ("", "b")]), (2, [("", "q")])], "sent_id long, c array<struct<name:string,value:string>>")
    cand = spark.createDataFrame([(1, ("", "x"), "w1", 0), (1, ("", "x"), "w2", 1), (1, ("", "y"), "w2", 0), (1, ("", "y"), "w3", 1)], "sent_id long, item struct<name:string,value:string>, word string, pos int")
    for k, words in ((1, ["w2"]), (3, ["w2", "w3", "w1"])):
        got = {r.sent_id: r.words for r in lookup.query(s, rules, cand, k).collect()}
        assert got == {1: words, 2: []}
    a, b = (sorted(map(str, m(s, rules).select("sent_id", "antecedent", "decision").collect())) for m in (lookup.match_by_counting, lookup.match_by_containment))
    assert a == b and len(a) == 2
    assert [r.decision.value for r in lookup.best_by_confidence(lookup.match_by_counting(s, rules)).collect()] == ["x"]


def test_accuracy(spark):
    p = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 1, "r")], "sent_id long, rank int, word string")
    gold = spark.createDataFrame([(1, "q"), (2, "r"), (3, "s")], "sent_id long, word string")
    rows = sorted(tuple(r) for r in evaluate.cumulative_accuracy(p, gold, 2).collect())
    assert rows == [(1, 3, 1, 1 / 3), (2, 3, 2, 2 / 3)]
    assert evaluate.padded(p, gold, 2).filter("word = ''").count() == 3
    with pytest.raises(Exception, match="gold word is empty"):
        evaluate.cumulative_accuracy(p, spark.createDataFrame([(1, "")], gold.schema), 2).collect()


def test_swept_accuracy_equals_cell_by_cell(spark):
    r = Random(5)
    rows = [([f"{n}={r.choice('uv')}" for n in "ABC"], [f"Q={r.choice('xyz')}"]) for _ in range(50)]
    t = tx(spark, rows)
    s = t.select(F.col("tid").alias("sent_id"), "c")
    gold = t.select(F.col("tid").alias("sent_id"), F.col("d")[0]["value"].alias("word"))
    known = spark.createDataFrame([(("Q", x), x, 0) for x in "xyz"], "item struct<name:string,value:string>, word string, pos int")
    cand = s.select("sent_id").join(known)
    grid = [(2, 0.2), (4, 0.45)]
    got = {(x.experiment_id, x.k): (x.total, x.correct) for x in sweep.swept_accuracy(mining.rule_counts(t, 2), grid, s, cand, gold, 2).collect()}
    for i, (a, b) in enumerate(grid, 1):
        words = lookup.top_words(lookup.match_by_counting(s, mining.mine_rules(t, a, b)), cand, 2)
        for x in evaluate.cumulative_accuracy(words, gold, 2).collect():
            assert got[i, x.k] == (x.total, x.correct)


def test_items(spark):
    odd = [("A", "x"), ("A", "it's"), ("A", 'say "x"'), ("A", "it's \"x\""), ("A", "back\\slash"), ("A", "a\nb\tc"), ("疑", "问\\n'")]
    df = spark.createDataFrame(odd, "name string, value string").select(F.struct("name", "value").alias("x"), I.item_text(F.struct("name", "value")).alias("t"))
    for r in df.withColumn("p", I.parse_item(F.col("t"))).collect():
        assert r.t == str(tuple(r.x)) and tuple(r.p) == tuple(r.x)
    kinds = {n: r for n, r in spark.createDataFrame([("SENTENCE_X",), ("QUESTION_Y",), ("SAME_DEPENDENCY",)], "n string").select("n", I.kind(F.col("n"))).collect()}
    assert kinds == {"SENTENCE_X": "C", "QUESTION_Y": "D", "SAME_DEPENDENCY": "D"}


def test_pivot_last_wins_and_round_trip(spark):
    long = spark.createDataFrame([(1, 0, "A", "1"), (1, 1, "B", "x"), (1, 2, "A", "2"), (2, 0, "B", None)], "tid long, ord int, name string, value string")
    wide = {r.tid: (r.A, r.B) for r in reshape.pivot_last_wins(long, "tid").collect()}
    assert wide == {1: ("2", "x"), 2: (None, None)}
    words = reshape.dictionary(long)
    assert sorted(r.id for r in words.collect()) == list(range(5))
    assert reshape.decode(reshape.encode(long, words), words).select("tid", "name", "value").exceptAll(long.select("tid", "name", "value")).isEmpty()
    assert {(r.name, r.value) for r in reshape.unpivot(reshape.pivot_last_wins(long, "tid"), ["tid"]).collect()} == {("A", "2"), ("B", "x")}


def test_data_sets(spark):
    full = spark.createDataFrame([("k1", 0), ("k2", 1), ("k1", 2)], "k string, row_idx long")
    part = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("k9",)], "k string")
    assert sorted(r.row_idx for r in datasets.keyed_subset(full, part, ["k"]).collect()) == [1, 1, 2]
    assert [r.k for r in datasets.unmatched(part, full, keys=["k"]).collect()] == ["k9"]
    rows = spark.range(107).select((106 - F.col("id")).alias("x"))
    numbered = datasets.numbered(rows, ["x"])
    assert all(r.x == r.row_idx for r in numbered.collect())
    sizes = {r["dataset"]: r["count"] for r in datasets.cumulative_shards(numbered, 7, 10, 107).groupBy("dataset").count().collect()}
    assert sizes == {i: 10 * i for i in range(1, 11)}
    assert datasets.equal(rows, rows.orderBy("x")) and not datasets.equal(rows, rows.union(rows.limit(1)))
    assert datasets.sample_fixed(rows, 20, 1).count() == 20
    assert sorted(map(tuple, datasets.sample_fixed(rows, 20, 1).collect())) == sorted(map(tuple, datasets.sample_fixed(rows.orderBy("x"), 20, 1).collect()))


def test_fpgrowth_by_digits_of_weights(spark):
    """As many baskets as distinct rows have binary digits, however often rows occur; the same rules as by repeated rows and by counting."""
    rows = [([("A", str(i % 3)), ("B", str(i % 5))], [("Q", str(i % 2)), ("R", str(i % 4))], 1000 * i + 3) for i in range(12)] + [([], [("Q", "1")], 5), ([("A", "1")], [], 4)]
    t = spark.createDataFrame(rows, "c array<struct<name:string,value:string>>, d array<struct<name:string,value:string>>, w long")
    text = lambda df: sorted((str(r.antecedent), str(r.decision), round(r.confidence, 12)) for r in df.collect())
    digits, repeats = (text(mining.mine_with_fpgrowth(t, 4000, 0.1, most=n)) for n in (10**7, 0))
    assert digits == repeats and len(digits) > 10
    whole = t.filter("size(c) > 0 and size(d) > 0")
    assert text(mining.mine_with_fpgrowth(whole, 4000, 0.1)) == text(mining.mine_rules(whole, 4000, 0.1))
    assert not mining.mine_with_fpgrowth(whole.limit(0), 1, 0.1).collect()
    huge = whole.withColumn("w", F.col("w") * 1_000_000_000)
    assert text(mining.mine_with_fpgrowth(huge, 4000, 0.1)) == text(mining.mine_rules(huge, 4000, 0.1))


def test_sampled_lines_meet_orders_after_the_draw(spark, tmp_path):
    """The same lines as drawn from all, also where few of the first drawn have an order; only those are broadcast to the orders."""
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").filter("o_orderkey % 7 = 0" if t == "orders" else "true").write.parquet(f"{tmp_path}/{t}.parquet")
    key = lambda df: sorted((r.l_orderkey, r.l_linenumber, r.o_orderpriority) for r in df.collect())
    want = key(datasets.sample_fixed(catalog.lines(spark, str(tmp_path)), 20, by=["l_orderkey", "l_linenumber"]))
    for first in (1000, 20, 0):
        assert key(catalog.sampled_lines(spark, str(tmp_path), 20, first)) == want
    assert "lineitem" not in str(catalog.sampled_lines(spark, str(tmp_path), 20).inputFiles())
