"""Registered queries and their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import items as I
from .functions.text import WORD, sentence_pattern, stripped
from .operators import datasets, evaluate, features, lookup, mining, paths, reshape
from .plans import sweep
from .sources import readers
from .store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SUPPORT, CONFIDENCE, K = 100, 0.2, 3


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- order lines as transactions: conditions are return flag, line status, order status and line number, the decision is the priority

CONDITIONS = ["l_returnflag", "l_linestatus", "o_orderstatus", "l_linenumber"]
DECISION = "o_orderpriority"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return _with_orders(rows, spark, sf_dir)


def _with_orders(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return rows.join(orders, rows["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct transactions of all lines and their weights, written once: a query derives all it needs from them."""
    return written(line_transactions(spark, sf_dir), "line-transactions")


def line_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.weighted_transactions(lines(spark, sf_dir), [*CONDITIONS, DECISION], [DECISION])


def labelled(df: DataFrame) -> DataFrame:
    """Antecedent and decision as text, so that all engines hash them alike."""
    out = df.withColumn("antecedent", I.label(F.col("antecedent")))
    if "decision" in df.columns:
        out = out.withColumn("decision", F.concat_ws("=", "decision.name", "decision.value"))
    return out


LINES = """
lines AS (
    SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, o_orderdate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
TRANSACTIONS = (
    LINES
    + """,
tx AS (
    SELECT ['l_linenumber=' || l_linenumber, 'l_linestatus=' || l_linestatus, 'l_returnflag=' || l_returnflag, 'o_orderstatus=' || o_orderstatus] AS c,
        'o_orderpriority=' || o_orderpriority AS d, count(*) AS w
    FROM lines GROUP BY ALL
),
sub AS (
    SELECT array_to_string(list_filter(c, lambda x, i: (m >> (i - 1)) & 1 = 1), '|') AS antecedent,
        len(list_filter(c, lambda x, i: (m >> (i - 1)) & 1 = 1)) AS k, c, d, w
    FROM tx, range(1, 16) r(m)
),
na AS (SELECT antecedent, any_value(k) AS k, sum(w)::BIGINT AS n_a FROM sub GROUP BY 1),
nad AS (SELECT antecedent, d AS decision, sum(w)::BIGINT AS n_ad FROM sub GROUP BY 1, 2),
total AS (SELECT sum(w)::BIGINT AS n FROM tx),
pairs AS (SELECT antecedent, decision, n_ad, n_a, n, k, n_ad / n AS support, n_ad / n_a AS confidence FROM nad JOIN na USING (antecedent), total)"""
)
RULES = TRANSACTIONS + f",\nrules AS (SELECT * FROM pairs WHERE n_ad > {SUPPORT} AND n_a > {SUPPORT} AND confidence > {CONFIDENCE})"


@_query(
    f"""WITH {LINES}
SELECT l_orderkey, name, value FROM lines, LATERAL (VALUES ('l_returnflag', l_returnflag), ('l_linestatus', l_linestatus), ('o_orderstatus', o_orderstatus), ('l_linenumber', l_linenumber::VARCHAR), ('o_orderpriority', o_orderpriority)) v(name, value)
WHERE value IS NOT NULL"""
)
def txn_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("_n", F.col("l_linenumber"))
    return reshape.unpivot(rows, ["l_orderkey"], ["l_returnflag", "l_linestatus", "o_orderstatus", "_n", "o_orderpriority"]).select(
        "l_orderkey", F.when(F.col("name") == "_n", "l_linenumber").otherwise(F.col("name")).alias("name"), "value"
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, name, value: what is known of a document, the language twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), x.alias("value")) for i, n, x in ((0, "SENTENCE_LANG", F.upper("lang")), (1, "SENTENCE_SOURCE", F.col("source")), (2, "SENTENCE_LANG", F.col("lang")))))))
    more = labels.select("doc_id", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for i, n, c in ((3, "QUESTION_QUALITY", "quality"), (4, "SAME_QS_WORD", "toxic"))))))
    return first.unionByName(more).filter("value is not null")


RECORDS = """
records AS (
    SELECT doc_id, ord, name, value FROM (
        SELECT doc_id, 0 AS ord, 'SENTENCE_LANG' AS name, upper(lang) AS value FROM documents
        UNION ALL SELECT doc_id, 1, 'SENTENCE_SOURCE', source FROM documents
        UNION ALL SELECT doc_id, 2, 'SENTENCE_LANG', lang FROM documents
        UNION ALL SELECT doc_id, 3, 'QUESTION_QUALITY', quality::VARCHAR FROM labels
        UNION ALL SELECT doc_id, 4, 'SAME_QS_WORD', toxic::VARCHAR FROM labels
    ) WHERE value IS NOT NULL
)"""


@_query(
    f"""WITH {RECORDS}, last AS (SELECT doc_id, name, value FROM records QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY ord DESC, value DESC) = 1)
SELECT doc_id, max(value) FILTER (name = 'QUESTION_QUALITY') AS "QUESTION_QUALITY", max(value) FILTER (name = 'SAME_QS_WORD') AS "SAME_QS_WORD",
    max(value) FILTER (name = 'SENTENCE_LANG') AS "SENTENCE_LANG", max(value) FILTER (name = 'SENTENCE_SOURCE') AS "SENTENCE_SOURCE"
FROM last GROUP BY doc_id"""
)
def txn_pivot_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_last_wins(document_records(spark, sf_dir), "doc_id")


@_query(f"""WITH {RECORDS} SELECT name, CASE WHEN contains(name, 'QUESTION') OR name IN ('SAME_QS_WORD', 'SAME_DEPENDENCY', 'DEPENDENCY_PATH') THEN 'D' ELSE 'C' END AS kind, count(*) AS n FROM records GROUP BY 1, 2""")
def item_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_records(spark, sf_dir).groupBy("name", I.kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


DICTIONARY = RECORDS + ", strings AS (SELECT DISTINCT unnest([name, value]) AS str FROM records), words AS (SELECT str, row_number() OVER (ORDER BY encode(str)) - 1 AS id FROM strings)"


@_query(f"WITH {DICTIONARY} SELECT str, id FROM words")
def item_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.dictionary(document_records(spark, sf_dir))


@_query(f"WITH {DICTIONARY} SELECT n.id AS name_id, v.id AS value_id, count(*) AS n FROM records JOIN words n ON name = n.str JOIN words v ON value = v.str GROUP BY 1, 2")
def item_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    return reshape.encode(records, reshape.dictionary(records)).groupBy("name_id", "value_id").agg(F.count("*").alias("n"))


@_query(f"WITH {RECORDS} SELECT name, value, count(*) AS n FROM records GROUP BY 1, 2")
def item_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    words = reshape.dictionary(records)
    return reshape.decode(reshape.encode(records, words), words).groupBy("name", "value").agg(F.count("*").alias("n"))


@_query(f"WITH {RECORDS} SELECT '(''' || name || ''', ''' || value || ''')' AS item, name, value, count(*) AS n FROM records GROUP BY name, value")
def item_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = document_records(spark, sf_dir).groupBy(I.item_text(F.struct("name", "value")).alias("item")).agg(F.count("*").alias("n"))
    return shown.withColumn("p", I.parse_item(F.col("item"))).select("item", "p.name", "p.value", "n")


# --- mining


@_query(f"WITH {TRANSACTIONS} SELECT antecedent, n_a AS n, count(*) AS n_decisions FROM pairs GROUP BY 1, 2")
def itemset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(mining.itemset_counts(line_transactions(spark, sf_dir)))


@_query(f"WITH {TRANSACTIONS} SELECT antecedent, n_a AS n FROM na WHERE n_a > {SUPPORT}")
def frequent_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(mining.frequent_antecedents(line_transactions(spark, sf_dir), SUPPORT))


def rules_of(tx: DataFrame) -> DataFrame:
    return mining.mine_rules(tx, SUPPORT, CONFIDENCE)


@_query(f"WITH {RULES} SELECT antecedent, decision, n_ad, n_a, support, confidence FROM rules")
def rules_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(rules_of(line_transactions(spark, sf_dir))).select("antecedent", "decision", "n_ad", "n_a", "support", "confidence")


@_query(
    """WITH tx AS (
    SELECT list_filter(['lang=' || lang, 'source=' || source], lambda x: x IS NOT NULL) AS c, list_filter(['quality=' || quality, 'toxic=' || toxic], lambda x: x IS NOT NULL) AS d, count(*) AS w
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL
), sub AS (SELECT array_to_string(list_filter(c, lambda x, i: (m >> (i - 1)) & 1 = 1), '|') AS antecedent, d, w FROM tx, range(1, 4) r(m)),
na AS (SELECT antecedent, sum(w)::BIGINT AS n_a FROM sub GROUP BY 1),
one AS (SELECT antecedent, unnest(d) AS decision, w AS n_ad FROM sub)
SELECT antecedent, decision, sum(n_ad)::BIGINT AS n_ad, any_value(n_a) AS n_a, sum(n_ad) / any_value(n_a) AS confidence FROM one JOIN na USING (antecedent)
GROUP BY 1, 2 HAVING sum(n_ad) > 5 AND any_value(n_a) > 5 AND sum(n_ad) / any_value(n_a) > 0.3"""
)
def rules_multi_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    found = mining.mine_rules(reshape.weighted_transactions(rows, ["lang", "source", "quality", "toxic"], ["quality", "toxic"]), 5, 0.3)
    return labelled(found).select("antecedent", "decision", "n_ad", "n_a", "confidence")


@_query(f"WITH {RULES} SELECT antecedent, decision, n_ad, n_a, n FROM rules")
def rules_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of early and late orders, merged."""
    rows = lines(spark, sf_dir)
    halves = [rows.filter(F.col("o_orderdate") < "1995-07-01"), rows.filter((F.col("o_orderdate") >= "1995-07-01") | F.col("o_orderdate").isNull())]
    counts = [mining.rule_counts(reshape.weighted_transactions(h, [*CONDITIONS, DECISION], [DECISION])) for h in halves]
    return labelled(mining.rules(mining.merged_counts(*counts), SUPPORT, CONFIDENCE)).select("antecedent", "decision", "n_ad", "n_a", "n")


# --- lookup: the distinct condition sets of all lines are the sentences, each with its weight


def line_sentences(tx: DataFrame) -> DataFrame:
    """sent_id (the set as text), c, gold, w: every condition set with every priority that it has."""
    return tx.select(I.label(F.col("c")).alias("sent_id"), "c", F.col("d")[0].alias("gold"), "w")


def line_sets(tx: DataFrame) -> DataFrame:
    return line_sentences(tx).select("sent_id", "c").distinct()


def line_gold(tx: DataFrame) -> DataFrame:
    """sent_id, word, w: a row and weight for each gold word of a set."""
    return line_sentences(tx).select("sent_id", F.lower(F.substring_index(F.col("gold.value"), "-", -1)).alias("word"), "w")


def line_candidates(tx: DataFrame) -> DataFrame:
    """sent_id, item, word, pos: each priority stands for its name and its number."""
    item = F.col("gold")
    words = F.array(F.lower(F.substring_index(item["value"], "-", -1)), F.substring_index(item["value"], "-", 1))
    known = line_sentences(tx).select(item.alias("item"), F.posexplode(words).alias("pos", "word")).distinct()
    return _candidates_of(line_sets(tx), known)


def _candidates_of(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """All sentences share the few candidate words of the priorities, folded into one array."""
    held = known.agg(F.array_sort(F.collect_list(F.struct("item", "word", "pos")))).scalar()
    return sentences.select("sent_id", F.inline(held)).select("sent_id", "item", "word", "pos")


SENTENCES = RULES + ",\nsents AS (SELECT DISTINCT array_to_string(c, '|') AS sent_id, c FROM tx)"
MATCHES = SENTENCES + ",\nfired AS (SELECT sent_id, antecedent, decision, confidence, support, n_ad, n_a, n FROM sents, rules WHERE list_has_all(c, string_split(antecedent, '|')))"
WORDS = (
    MATCHES
    + """,
best AS (SELECT sent_id, decision, max(round(confidence::DECIMAL(38, 20), 10)::DOUBLE * round(support::DECIMAL(38, 20), 10)::DOUBLE) AS score FROM fired GROUP BY 1, 2),
ranked AS (SELECT sent_id, decision, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, decision DESC) AS rank FROM best),
cand AS (SELECT sent_id, rank, unnest([{'word': lower(string_split(split_part(decision, '=', 2), '-')[-1]), 'pos': 0}, {'word': split_part(split_part(decision, '=', 2), '-', 1), 'pos': 1}], recursive := true) FROM ranked),
firsts AS (SELECT sent_id, word, min(rank * 10 + pos) AS place FROM cand GROUP BY 1, 2),
words AS (SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY place, word) AS rank, word FROM firsts)"""
)


@_query(f"WITH {RULES} SELECT unnest(string_split(antecedent, '|')) AS item, antecedent, decision, k::INTEGER AS k, confidence, support FROM rules")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(lookup.postings(rules_of(line_transactions(spark, sf_dir)))).withColumn("item", F.concat_ws("=", "item.name", "item.value"))


@_query(f"WITH {MATCHES} SELECT sent_id, antecedent, decision, confidence, support FROM fired")
def rule_match_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return labelled(lookup.match_by_counting(line_sets(tx), rules_of(tx))).select("sent_id", "antecedent", "decision", "confidence", "support")


@_query(ORACLE_SQL["rule_match_counting"])
def rule_match_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return labelled(lookup.match_by_containment(line_sets(tx), rules_of(tx))).select("sent_id", "antecedent", "decision", "confidence", "support")


@_query(f"WITH {MATCHES} SELECT sent_id, antecedent, decision, confidence FROM fired QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY confidence DESC, len(string_split(antecedent, '|')) DESC, antecedent DESC, decision DESC) = 1")
def best_rule_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return labelled(lookup.best_by_confidence(lookup.match_by_counting(line_sets(tx), rules_of(tx))))


@_query(f"WITH {WORDS} SELECT sent_id, rank::INTEGER AS rank, word FROM words WHERE rank <= {K}")
def topk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_words(line_table(spark, sf_dir))


def _top_words(tx: DataFrame) -> DataFrame:
    return lookup.top_words(lookup.match_by_counting(line_sets(tx), rules_of(tx)), line_candidates(tx), K)


LISTS = "lists AS (SELECT sent_id, string_agg(word, ',' ORDER BY rank) AS words FROM words WHERE rank <= {k} GROUP BY 1)".format(k=K)
LINE_SET = "'l_linenumber=' || l_linenumber || '|l_linestatus=' || l_linestatus || '|l_returnflag=' || l_returnflag || '|o_orderstatus=' || o_orderstatus"


@_query(f"WITH {WORDS}, {LISTS} SELECT l_orderkey, l_linenumber, coalesce(words, '') AS words FROM lines LEFT JOIN lists ON sent_id = {LINE_SET}")
def query_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its words: the distinct sets are queried, and all lines take the words of their set."""
    tx = line_table(spark, sf_dir)
    found = lookup.query(line_sets(tx), rules_of(tx), line_candidates(tx), K).withColumn("words", F.array_join("words", ","))
    rows = reshape.transactions(lines(spark, sf_dir).withColumn("at", F.struct("l_orderkey", "l_linenumber")), "at", [*CONDITIONS, DECISION], [DECISION])
    rows = rows.select("tid.l_orderkey", "tid.l_linenumber", I.label(F.col("c")).alias("sent_id"))
    return rows.join(found, "sent_id", "left").select("l_orderkey", "l_linenumber", F.coalesce("words", F.lit("")).alias("words"))


@_query(f"WITH {WORDS}, {LISTS}, one AS (SELECT min(sent_id) AS sent_id FROM sents) SELECT sent_id, coalesce(words, '') AS words FROM one LEFT JOIN lists USING (sent_id)")
def single_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence, the first set in text order: a single query is the feature."""
    tx = line_table(spark, sf_dir)
    one = line_sets(tx).orderBy("sent_id").limit(1)
    candidates = line_candidates(tx).join(one.select("sent_id"), "sent_id", "left_semi")
    return lookup.query(one, rules_of(tx), candidates, K).withColumn("words", F.array_join("words", ","))


GOLD = ",\ngold AS (SELECT array_to_string(c, '|') || '#' || d AS gold_id, array_to_string(c, '|') AS sent_id, lower(string_split(d, '-')[-1]) AS gold, w FROM tx), hit AS (SELECT gold_id, w, (SELECT min(rank) FROM words WHERE words.sent_id = gold.sent_id AND word = gold) AS hit FROM gold)"


@_query(f"WITH {WORDS}{GOLD} SELECT k::INTEGER AS k, sum(w)::BIGINT AS total, sum(CASE WHEN hit <= k THEN w ELSE 0 END)::BIGINT AS correct, sum(CASE WHEN hit <= k THEN w ELSE 0 END) / sum(w) AS accuracy FROM hit, range(1, {K + 1}) r(k) GROUP BY k")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return evaluate.cumulative_accuracy(_top_words(tx), line_gold(tx), K)

@_query(f"WITH {WORDS} SELECT sent_id, r.rank::INTEGER AS rank, coalesce(word, '') AS word FROM (SELECT sent_id, unnest(range(1, {K + 1})) AS rank FROM sents) r LEFT JOIN words USING (sent_id, rank)")
def padded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return evaluate.padded(_top_words(tx), line_sets(tx), K)


GRID = sweep.Grid((50, 150, 50), (10, 30, 5), K)


@_query(
    f"""WITH {TRANSACTIONS}
SELECT s AS min_support, c / 100 AS min_confidence, count(*) AS n_rules, sum(n_ad)::BIGINT AS sum_n_ad
FROM pairs, (SELECT unnest([50, 100, 150])::BIGINT AS s) gs, (SELECT unnest([10, 15, 20, 25, 30]) AS c) gc WHERE n_ad > s AND n_a > s AND confidence > c / 100 GROUP BY 1, 2"""
)
def grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep.swept_rules(mining.rule_counts(line_transactions(spark, sf_dir), 50), GRID.cells())
    return found.groupBy("min_support", "min_confidence").agg(F.count("*").alias("n_rules"), F.sum("n_ad").alias("sum_n_ad"))


def _sweep_sql(cells: str, k: int) -> str:
    """CTEs that end in ``sums``: experiment_id, s, c, k, total, correct for the rows (experiment_id, s, c) of ``cells``."""
    return f"""{TRANSACTIONS},
cells AS ({cells}),
sents AS (SELECT DISTINCT array_to_string(c, '|') AS sent_id, c FROM tx),
fired AS (SELECT sent_id, decision, n_ad, n_a, confidence, round(confidence::DECIMAL(38, 20), 10)::DOUBLE * round(support::DECIMAL(38, 20), 10)::DOUBLE AS score
    FROM sents, pairs WHERE n_ad > (SELECT min(s) FROM cells) AND confidence > (SELECT min(c) FROM cells) AND list_has_all(sents.c, string_split(antecedent, '|'))),
best AS (SELECT experiment_id, sent_id, decision, max(score) AS score FROM fired, cells x WHERE n_ad > x.s AND n_a > x.s AND confidence > x.c GROUP BY 1, 2, 3),
ranked AS (SELECT experiment_id, sent_id, decision, row_number() OVER (PARTITION BY experiment_id, sent_id ORDER BY score DESC, decision DESC) AS rank FROM best),
cand AS (SELECT experiment_id, sent_id, rank, unnest([{{'word': lower(string_split(split_part(decision, '=', 2), '-')[-1]), 'pos': 0}}, {{'word': split_part(split_part(decision, '=', 2), '-', 1), 'pos': 1}}], recursive := true) FROM ranked),
firsts AS (SELECT experiment_id, sent_id, word, min(rank * 10 + pos) AS place FROM cand GROUP BY 1, 2, 3),
words AS (SELECT experiment_id, sent_id, word, row_number() OVER (PARTITION BY experiment_id, sent_id ORDER BY place, word) AS rank FROM firsts),
gold AS (SELECT array_to_string(c, '|') AS sent_id, lower(string_split(d, '-')[-1]) AS word, w FROM tx),
hit AS (SELECT experiment_id, rank, sum(w)::BIGINT AS w FROM gold JOIN words USING (sent_id, word) GROUP BY 1, 2),
sums AS (SELECT x.experiment_id, x.s, x.c, k.k, (SELECT sum(w)::BIGINT FROM gold) AS total, coalesce((SELECT sum(w)::BIGINT FROM hit WHERE hit.experiment_id = x.experiment_id AND hit.rank <= k.k), 0) AS correct
    FROM cells x, range(1, {k + 1}) k(k))"""


GRID_CELLS = "SELECT (row_number() OVER (ORDER BY s, c))::INTEGER AS experiment_id, s, c / 100 AS c FROM (SELECT unnest([50, 100, 150])::BIGINT AS s), (SELECT unnest([10, 15, 20, 25, 30]) AS c)"
SWEEP = f"WITH {_sweep_sql(GRID_CELLS, K)} SELECT experiment_id, s AS support_value, c AS min_confidence, k::INTEGER AS i, total, correct, round(correct / total, 10) AS accuracy FROM sums"


@_query(SWEEP)
def sweep_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = line_table(spark, sf_dir)
    return sweep.report(sweep.swept_accuracy(mining.rule_counts(tx, 50), GRID.cells(), line_sets(tx), line_candidates(tx), line_gold(tx), K))


#: The grids as rows: name, supports and confidences (first, last), words that count.
GRIDS = "(VALUES ('experiment_1', 20, 70, 20, 85, 1), ('experiment_2', 5, 30, 5, 45, 5), ('experiment_3', 20, 70, 20, 85, 5), ('experiment_4', 20, 70, 20, 85, 5), ('experiment_5', 5, 30, 5, 30, 5), ('experiment_6', 5, 50, 5, 50, 1)) g(experiment, s0, s1, c0, c1, most)"
GRID_ROWS = f"SELECT experiment, most, s::BIGINT AS s, c / 100 AS c, (row_number() OVER (PARTITION BY experiment ORDER BY s, c))::INTEGER AS experiment_id FROM {GRIDS}, range(5, 75, 5) rs(s), range(5, 90, 5) rc(c) WHERE s BETWEEN s0 AND s1 AND c BETWEEN c0 AND c1"


@_query(
    f"""WITH {_sweep_sql(f"SELECT DISTINCT (s * 1000 + round(c * 100))::INTEGER AS experiment_id, s, c FROM ({GRID_ROWS})", 5)}, asked AS ({GRID_ROWS})
SELECT experiment, a.experiment_id, s AS support_value, c AS min_confidence, k::INTEGER AS i, total, correct, round(correct / total, 10) AS accuracy
FROM asked a JOIN (SELECT s, c, k, total, correct FROM sums) x USING (s, c) WHERE k <= most"""
)
def experiment_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids of all six experiments, every cell."""
    tx = line_table(spark, sf_dir)
    return sweep.experiments_accuracy(mining.rule_counts(tx, 5), line_sets(tx), line_candidates(tx), line_gold(tx))


def sampled_lines(spark: SparkSession, sf_dir: str, n: int, first: int = 1000) -> DataFrame:
    """``datasets.sample_fixed`` of all lines by their keys, which are drawn first: only the ``first`` ones meet the orders.

    The sample lies in them if n of them have an order; else all lines are joined.
    """
    by = ["l_orderkey", "l_linenumber"]
    drawn = written(datasets.sample_fixed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), max(n, first), by=by), "drawn")
    found = datasets.sample_fixed(_with_orders(F.broadcast(drawn), spark, sf_dir), n, by=by)
    return found if found.count() == n else datasets.sample_fixed(lines(spark, sf_dir), n, by=by)


@_query()
def timing_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sampled lines, the size of the sample being the feature, in every cell of the timed experiment."""
    some = sampled_lines(spark, sf_dir, 20).withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    sentences = reshape.transactions(some, "at", [*CONDITIONS, DECISION], [DECISION]).select(F.to_json("tid").alias("sent_id"), "c")
    return sweep.timed_lookup(mining.rule_counts(line_table(spark, sf_dir), 20), sweep.EXPERIMENTS["experiment_1"].cells(), sentences)


@_query(
    """WITH w AS (SELECT c_mktsegment AS word, c_nationkey AS sent_id, list_sort(list_distinct(list(CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END))) AS items FROM customer GROUP BY ALL),
u AS (SELECT s_nationkey AS sent_id, list_sort(list_distinct(list(CASE WHEN s_acctbal > 0 THEN 'plus' ELSE 'minus' END))) AS usable FROM supplier GROUP BY ALL),
g AS (SELECT sent_id, items, string_agg(word, ',' ORDER BY word) AS words FROM w GROUP BY ALL)
SELECT sent_id, array_to_string(items, '|') AS items, words, len(list_intersect(items, usable)) / len(items) AS share,
    row_number() OVER (PARTITION BY sent_id ORDER BY len(items) DESC, array_to_string(items, '|'))::INTEGER AS rank
FROM g JOIN u USING (sent_id) WHERE len(list_intersect(items, usable)) / len(items) > 0.21"""
)
def overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = lambda c: F.array_sort(F.collect_set(F.struct(F.lit("").alias("name"), F.when(F.col(c) > 0, "plus").otherwise("minus").alias("value"))))
    words = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("sent_id"), F.col("c_mktsegment").alias("word")).agg(sign("c_acctbal").alias("items"))
    usable = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sent_id")).agg(sign("s_acctbal").alias("items"))
    found = lookup.overlap_match(words, usable)
    return found.select("sent_id", F.array_join(F.transform("items", lambda x: x["value"]), "|").alias("items"), F.array_join("words", ",").alias("words"), "share", "rank")


# --- data sets


@_query(
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders),
p AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 5000),
last AS (SELECT o_custkey, max(row_idx) AS row_idx FROM n WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT n.* FROM p JOIN last ON k = o_custkey JOIN n USING (row_idx)"""
)
def subset_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders by customer and status, the last of each; customers above a balance are asked for twice."""
    full = datasets.numbered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])
    customers = table(spark, sf_dir, "customer")
    part = customers.unionAll(customers.filter("c_acctbal > 5000")).select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return datasets.keyed_subset(full, part, ["o_custkey", "o_orderstatus"])


@_query("SELECT c_custkey AS o_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmatched_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return datasets.unmatched(part, orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'P'"), keys=["o_custkey"])


@_query("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.numbered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


@_query(
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS total FROM orders)
SELECT CASE WHEN row_idx < total - total // 5 THEN 'train' ELSE 'test' END AS part, * EXCLUDE (total) FROM n"""
)
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = datasets.numbered(table(spark, sf_dir, "orders"), ["o_orderkey"])
    total = orders.count()
    cut = total - total // 5
    return datasets.head(orders, cut).withColumn("part", F.lit("train")).unionByName(datasets.tail(orders, cut).withColumn("part", F.lit("test")))


@_query(
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS total FROM orders),
c AS (SELECT * EXCLUDE (total), ((row_idx - 280) // ((total - 280) // 10))::INTEGER AS chunk FROM n WHERE row_idx >= 280)
SELECT c.*, d::INTEGER AS dataset FROM c, range(1, 11) r(d) WHERE chunk < 10 AND d > chunk"""
)
def cumulative_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = datasets.numbered(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return datasets.cumulative_shards(orders, 280, 10, orders.count())


@_query("SELECT o_orderkey, o_orderstatus FROM orders JOIN (SELECT c_custkey AS o_orderkey FROM customer UNION ALL SELECT c_custkey FROM customer) USING (o_orderkey)")
def positional_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return datasets.gather(orders, places.unionAll(places), "o_orderkey").select("o_orderkey", "o_orderstatus")


@_query(
    """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT 'left' AS side, o_orderstatus, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) GROUP BY ALL UNION ALL SELECT 'right', o_orderstatus, count(*) FROM (FROM b EXCEPT ALL FROM a) GROUP BY ALL"""
)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")))
    return datasets.difference(a, b).groupBy("side", "o_orderstatus").agg(F.count("*").alias("n"))


ORDERED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, row_number() OVER (ORDER BY {order}) - 1 AS row_idx FROM orders"


@_query(
    f"""WITH a AS ({ORDERED.format(order="o_orderkey")}), b AS ({ORDERED.format(order="o_custkey, o_orderkey")})
SELECT a.row_idx AS row, list_filter([CASE WHEN a.o_orderkey <> b.o_orderkey THEN 'o_orderkey' END, CASE WHEN a.o_custkey <> b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END], lambda x: x IS NOT NULL).array_to_string(',') AS columns
FROM a JOIN b USING (row_idx) WHERE columns <> ''"""
)
def ordered_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in two orders: where they differ, and in which columns."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    found = datasets.differences_in_order(datasets.numbered(rows, ["o_orderkey"]), datasets.numbered(rows, ["o_custkey", "o_orderkey"]))
    return found.withColumn("columns", F.array_join("columns", ","))


@_query("SELECT * FROM orders ORDER BY md5('7|' || o_orderkey) LIMIT 20")
def sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty orders, the size of a sample being the feature."""
    return datasets.sample_fixed(table(spark, sf_dir, "orders"), 20, seed=7, by=["o_orderkey"])


@_query(
    """SELECT event_id AS id, CASE WHEN event_id % 7 = 2 THEN 0 ELSE len(list_distinct(json_extract_string(props, '$.*'))) END::INTEGER AS n_items,
    CASE WHEN event_id % 7 = 3 THEN 0 ELSE len(json_keys(props)) END::INTEGER AS n_words
FROM events WHERE json_valid(props) AND event_id % 7 NOT IN (0, 1)"""
)
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as cleaned entries, read back. By number some are cut off in the middle, some have no data, a set that is no list, or a dict that is no object."""
    events = table(spark, sf_dir, "events")
    held = F.from_json("props", "map<string,string>")
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.map_values(held).alias("set"), F.transform_values(held, lambda k, v: F.array(v)).alias("dict")).alias("data")))
    kind = F.col("event_id") % 7
    broken = (
        F.when(kind == 0, F.substring(text, F.lit(1), F.length(text) - 4))
        .when(kind == 1, F.replace(text, F.lit('"data"'), F.lit('"other"')))
        .when(kind == 2, F.regexp_replace(text, r'"set":\[.*?\]', '"set":"no list"'))
        .when(kind == 3, F.regexp_replace(text, r'"dict":\{.*?\}', '"dict":17'))
        .otherwise(text)
    )
    found = readers.parse_cleaned(events.select(broken.alias("value")))
    return found.select("id", F.size("items").alias("n_items"), F.size("words").alias("n_words"))


# --- features of conversations, their tokens by fixed rules


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, text: the sentences of all texts, cut after their stops; what has no word is none.

    Texts are dealt out first, the one time that they are shuffled, as a file of few row groups makes few tasks, and in
    so many parts, as features and paths are many times as large as texts.
    """
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "text")
    cut = F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("i", "text")
    rows = rows.select("conv_id", "turn", cut).filter(F.col("text").rlike(WORD))
    return rows.select(((F.col("conv_id") * 100_000 + F.col("turn")) * 10_000 + F.col("i")).alias("sent_id"), "text")


def ids_meet(spark: SparkSession, sf_dir: str) -> bool:
    """Whether sentences may share an id: of a repeated turn, or one outside of what ids hold. Only keys are shuffled."""
    many = F.when(F.length("text") > 10_000, F.size(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(many).alias("most"))
    return not turns.filter("n > 1 or conv_id is null or turn is null or turn not between 0 and 99999 or most > 10000").isEmpty()


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their texts and tokens, a row for each id: all features of a sentence follow from its row."""
    return features.rule_sentences(sentences(spark, sf_dir), ids_meet(spark, sf_dir))


def known(rows: DataFrame) -> DataFrame:
    """Those with an id, with the last token in the part of a gold word."""
    return rows.filter("sent_id is not null").withColumn("gold", F.array(F.element_at("tokens", -1)["text"]))


SENTS = r"""cut AS (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?]+[.!?]*') AS parts FROM conversations WHERE text IS NOT NULL),
sents AS (SELECT sent_id, text FROM (SELECT (conv_id * 100000 + turn) * 10000 + generate_subscripts(parts, 1) - 1 AS sent_id, unnest(parts) AS text FROM cut) WHERE regexp_matches(text, '[\p{L}\p{N}]'))"""
TOKENS = (
    SENTS
    + r""",
parts AS (SELECT sent_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS text, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1) AS idx FROM sents),
toks AS MATERIALIZED (SELECT sent_id, idx, idx - 1 AS head, text, lower(text) AS low,
    CASE WHEN lower(text) IN ('what', 'who') THEN 'WP' WHEN lower(text) = 'whose' THEN 'WP$' WHEN lower(text) = 'which' THEN 'WDT' WHEN lower(text) IN ('when', 'how', 'where') THEN 'WRB'
        WHEN ends_with(lower(text), 'ed') THEN 'VBD' WHEN ends_with(lower(text), 'ing') THEN 'VBG' WHEN regexp_full_match(text, '\p{N}+') THEN 'CD' WHEN text <> lower(text) THEN 'NNP' ELSE 'NN' END AS xpos,
    CASE WHEN idx = 1 THEN 'root' WHEN lower(text) IN ('the', 'a', 'an') THEN 'det' WHEN length(text) % 3 = 0 THEN 'nsubj' WHEN length(text) % 3 = 1 THEN 'obl:npmod' ELSE 'amod' END AS deprel
    FROM parts),
links AS MATERIALIZED (SELECT t.sent_id, t.idx AS ord, t.deprel || '_' || (row_number() OVER (PARTITION BY t.sent_id, t.deprel ORDER BY t.idx) - 1) AS rel, coalesce(h.text, t.text) AS head, t.text AS dep FROM toks t LEFT JOIN toks h ON t.sent_id = h.sent_id AND t.head = h.idx),
rule AS (SELECT sent_id,
    min_by({'w': text, 'p': xpos, 'r': 1}, idx) FILTER (idx = 1 AND starts_with(xpos, 'VB')) AS r1,
    CASE WHEN bool_or(idx = 1 AND low = 'how') AND bool_or(idx = 2 AND low = 'many') THEN {'w': 'How many', 'p': min_by(xpos, idx), 'r': 2} END AS r2,
    min_by({'w': text, 'p': xpos, 'r': 3}, idx) FILTER (low IN ('who', 'what', 'when', 'which', 'how', 'where', 'whose')) AS r3,
    min_by({'w': text, 'p': xpos, 'r': 4}, idx) FILTER (starts_with(xpos, 'V')) AS r4,
    min_by({'w': text, 'p': xpos, 'r': 5}, idx) FILTER (text = low AND text <> upper(text)) AS r5
    FROM toks GROUP BY sent_id),
struct_words AS (SELECT sent_id, c.w AS word, c.p AS pos, c.r::INTEGER AS rule FROM (SELECT sent_id, coalesce(r1, r2, r3, r4, r5) AS c FROM rule)),
lasts AS (SELECT sent_id, max_by(text, idx) AS q FROM toks GROUP BY 1)"""
)


@_query(f"WITH {SENTS} SELECT sent_id, CASE WHEN ends_with(text, '?') THEN '疑问句' ELSE '陈述句' END AS pattern FROM sents")
def sentence_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("sent_id", sentence_pattern(F.col("text")).alias("pattern"))


@_query(rf"WITH {SENTS} SELECT sent_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[!-/:-@\[-`{{-~]$', '') AS stripped FROM sents")
def strip_trailing_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("sent_id", stripped(F.col("text")).alias("stripped"))


@_query(f"WITH {TOKENS} SELECT sent_id, word, pos, rule FROM struct_words")
def structure_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.structure_word(tokens(spark, sf_dir))


@_query(f"WITH {TOKENS} SELECT sent_id, ord::INTEGER AS ord, rel, head, dep FROM links")
def relation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.edges(tokens(spark, sf_dir))


@_query(f"WITH {TOKENS} SELECT l.sent_id, ord::INTEGER AS ord, 'SENTENCE_' || replace(upper(rel), ':', '_') AS name, CASE WHEN head = w THEN '1' ELSE '2' END AS value FROM links l JOIN (SELECT sent_id, CASE WHEN word = 'How many' THEN 'How' ELSE word END AS w FROM struct_words) s ON l.sent_id = s.sent_id AND (head = w OR dep = w)")
def edge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("tokens")
    places = features.positions_of(features.edges_of(ts), features.located(F.col("word")), "SENTENCE_")
    rows = known(tokens(spark, sf_dir)).select("sent_id", "tokens", features.structure_of(ts)["word"].alias("word")).filter("word is not null")
    return rows.select("sent_id", F.inline(places))


@_query(
    f"""WITH {TOKENS}, pairs AS (SELECT sent_id, word AS s, q FROM struct_words JOIN lasts USING (sent_id)),
hit AS (SELECT l.sent_id, q, ord, replace(upper(rel), ':', '_') AS rel, q = head AND s = dep AS h, q = dep AND s = head AS d FROM links l JOIN pairs USING (sent_id))
SELECT sent_id, q, ord::INTEGER AS ord, rel || '_1' AS value FROM hit WHERE h UNION ALL SELECT sent_id, q, ord::INTEGER, rel || '_2' FROM hit WHERE d"""
)
def direct_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("tokens")
    rows = known(tokens(spark, sf_dir)).select("sent_id", "tokens", "gold", features.structure_of(ts)["word"].alias("s")).filter("s is not null")
    found = F.filter(features.directs_of(features.edges_of(ts), F.col("s")), lambda x: F.array_contains("gold", x["q"]))
    return rows.select("sent_id", F.inline(found))


@_query(f"WITH {TOKENS} SELECT l.sent_id, t.text AS word, t.xpos AS pos FROM (SELECT sent_id, lower(q) AS q FROM lasts) l JOIN toks t ON l.sent_id = t.sent_id AND t.low = l.q QUALIFY row_number() OVER (PARTITION BY l.sent_id ORDER BY t.idx) = 1")
def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known(tokens(spark, sf_dir)).select("sent_id", features.answer_of(F.col("tokens"), F.col("gold")).alias("q")).select("sent_id", "q.word", "q.pos")


@_query(f"WITH {TOKENS} SELECT sent_id, q AS word, true AS ok FROM lasts JOIN sents USING (sent_id)")
def gold_word_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of last words; each is a run of letters and digits, so each is found in its sentence."""
    rows = known(tokens(spark, sf_dir)).select("sent_id", F.col("gold")[0].alias("word"), F.explode("texts").alias("text"))
    return features.checked(rows).select("sent_id", "word", "ok")


CONDITION_ROWS = """s AS (SELECT w.*, text FROM struct_words w JOIN sents USING (sent_id) WHERE word IS NOT NULL),
c AS (
    SELECT sent_id, 'SENTENCE_PATTERN' AS name, CASE WHEN ends_with(text, '?') THEN '疑问句' ELSE '陈述句' END AS value FROM s
    UNION ALL SELECT sent_id, 'SENTENCE_STRUCTURE_WORD', CASE WHEN pos = 'VB' OR (contains(pos, 'V') AND lower(word) NOT IN ('who', 'what', 'when', 'which', 'how', 'where', 'whose', 'how many') AND NOT ends_with(text, '?')) THEN 'VB' ELSE word END FROM s
    UNION ALL SELECT sent_id, 'SENTENCE_STRUCTURE_WORD_POS', pos FROM s
    UNION ALL SELECT l.sent_id, 'SENTENCE_' || replace(upper(rel), ':', '_'), CASE WHEN head = w THEN '1' ELSE '2' END FROM links l JOIN (SELECT sent_id, CASE WHEN word = 'How many' THEN 'How' ELSE word END AS w FROM s) x ON l.sent_id = x.sent_id AND (head = w OR dep = w)
)"""


@_query(
    f"WITH {TOKENS}, {CONDITION_ROWS} SELECT sent_id, name, value FROM c"
)
def condition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.condition_features(known(tokens(spark, sf_dir)))


#: Shortest paths from ``src`` (sent_id, source): distances first, then the walks along them.
PATHS = """src AS (SELECT sent_id, CASE WHEN word = 'How many' AND NOT contains(text, 'How') THEN 'how' WHEN word = 'How many' THEN 'How' ELSE word END AS source FROM struct_words JOIN sents USING (sent_id) WHERE word IS NOT NULL),
steps AS MATERIALIZED (SELECT sent_id, head AS a, dep AS b, '[' || rel || '：-->]' AS step FROM links WHERE head <> dep UNION ALL SELECT sent_id, dep, head, '[' || rel || '：<--]' FROM links WHERE head <> dep),
nexts AS MATERIALIZED (SELECT DISTINCT sent_id, a, b FROM steps),
sizes AS MATERIALIZED (SELECT sent_id, count(DISTINCT text) AS most FROM toks GROUP BY 1),
reach AS (SELECT sent_id, source AS node, 0 AS d FROM src UNION SELECT r.sent_id, b, d + 1 FROM reach r JOIN nexts n ON n.sent_id = r.sent_id AND n.a = r.node JOIN sizes z ON z.sent_id = r.sent_id WHERE d + 1 < most),
dist AS MATERIALIZED (SELECT sent_id, node, min(d) AS d FROM reach GROUP BY ALL),
walk AS (SELECT sent_id, source AS node, 0 AS d, '' AS path FROM src UNION ALL
    SELECT w.sent_id, t.node, t.d, CASE WHEN w.d = 0 THEN step ELSE path || ' --> ' || step END
    FROM walk w JOIN steps n ON n.sent_id = w.sent_id AND n.a = w.node JOIN dist t ON t.sent_id = n.sent_id AND t.node = n.b AND t.d = w.d + 1)"""
#: What makes a word of ``asked`` (sent_id, word, pos) the answer; paths are added by the queries.
DECISIONS = """s0 AS (SELECT sent_id, word AS s FROM struct_words WHERE word IS NOT NULL),
ask AS (SELECT DISTINCT sent_id, word AS q FROM asked),
qs AS (SELECT sent_id, s, q FROM s0 JOIN ask USING (sent_id)),
own AS (
    SELECT sent_id, q AS word, 'SAME_QS_WORD' AS name, 'True' AS value FROM qs WHERE q = s
    UNION SELECT l.sent_id, q, 'SAME_DEPENDENCY', replace(upper(rel), ':', '_') || '_1' FROM links l JOIN qs b ON l.sent_id = b.sent_id AND q = head AND s = dep
    UNION SELECT l.sent_id, q, 'SAME_DEPENDENCY', replace(upper(rel), ':', '_') || '_2' FROM links l JOIN qs b ON l.sent_id = b.sent_id AND q = dep AND s = head
    UNION SELECT sent_id, word, 'QUESTION_WORD', word FROM asked
    UNION SELECT sent_id, word, 'QUESTION_WORD_POS', pos FROM asked
    UNION SELECT l.sent_id, q, 'QUESTION_' || replace(upper(rel), ':', '_'), CASE WHEN head = q THEN '1' ELSE '2' END FROM links l JOIN ask a ON l.sent_id = a.sent_id AND (head = q OR dep = q)
)"""
ANSWERS = "asked AS (SELECT l.sent_id, t.text AS word, t.xpos AS pos FROM (SELECT sent_id, lower(q) AS q FROM lasts) l JOIN toks t ON l.sent_id = t.sent_id AND t.low = l.q QUALIFY row_number() OVER (PARTITION BY l.sent_id ORDER BY t.idx) = 1)"


@_query(
    f"""WITH RECURSIVE {TOKENS}, {CONDITION_ROWS}, {ANSWERS}, {DECISIONS}, {PATHS},
led AS (SELECT DISTINCT w.sent_id, path FROM walk w JOIN lasts l ON l.sent_id = w.sent_id AND node = q WHERE d > 0)
SELECT sent_id, name, value FROM c UNION ALL SELECT sent_id, name, value FROM own UNION ALL SELECT sent_id, 'DEPENDENCY_PATH', path FROM led"""
)
def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = known(tokens(spark, sf_dir))
    return features.training_table(None, rows, paths=paths.from_structure_word(None, rows, to=F.col("gold")))


@_query(
    f"""WITH RECURSIVE {TOKENS}, asked AS (SELECT DISTINCT sent_id, text AS word, xpos AS pos FROM toks), {DECISIONS}, {PATHS}, places AS (SELECT sent_id, text AS word, min(idx)::INTEGER AS place FROM toks GROUP BY 1, 2)
SELECT sent_id, word, place, name, value FROM (SELECT * FROM own UNION ALL SELECT DISTINCT sent_id, node, 'DEPENDENCY_PATH', path FROM walk WHERE d > 0) JOIN places USING (sent_id, word)"""
)
def query_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every sentence as a candidate: what makes it the answer, paths included."""
    rows = known(tokens(spark, sf_dir))
    _, candidates = features.query_table(None, rows, paths.from_structure_word(None, rows))
    return candidates.select("sent_id", "word", F.col("pos.idx").alias("place"), "item.name", "item.value")


@_query(f"WITH RECURSIVE {TOKENS}, {PATHS} SELECT w.sent_id, source, node AS target, path FROM walk w JOIN lasts l ON l.sent_id = w.sent_id AND node = q JOIN src ON src.sent_id = w.sent_id WHERE d > 0")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.paths_in(paths.starts(known(tokens(spark, sf_dir)), F.col("gold"))).drop("ord", "pos")


@_query(f"WITH RECURSIVE {TOKENS}, {PATHS} SELECT w.sent_id, source, node AS target, path FROM walk w JOIN src ON src.sent_id = w.sent_id WHERE d > 0")
def all_target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.paths_in(paths.starts(known(tokens(spark, sf_dir)))).drop("ord", "pos")


@_query(
    f"""WITH RECURSIVE {TOKENS}, {PATHS}, n AS (SELECT sent_id, node, d, count(*)::DOUBLE AS n_paths FROM walk WHERE d > 0 GROUP BY ALL)
SELECT n.sent_id, source, n.node, t.node AS "before", step, n.d::BIGINT AS steps, n_paths FROM n JOIN src ON src.sent_id = n.sent_id
    JOIN steps x ON x.sent_id = n.sent_id AND x.b = n.node JOIN dist t ON t.sent_id = n.sent_id AND t.node = x.a AND t.d = n.d - 1"""
)
def path_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that all shortest paths are made of, and how many paths there are to each word."""
    return paths.graph_in(paths.starts(known(tokens(spark, sf_dir))))


@_query(
    f"""WITH {TOKENS}, t AS (SELECT sent_id, string_agg(text || '/' || xpos, ' ' ORDER BY idx) AS words FROM toks GROUP BY 1), e AS (SELECT sent_id, string_agg(head || '>' || dep || ':' || rel, ' ' ORDER BY ord) AS edges FROM links GROUP BY 1)
SELECT sent_id, words, edges FROM t JOIN e USING (sent_id)"""
)
def sentence_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens with their tags, and the dependencies, of each sentence."""
    link = lambda x: F.concat(x["head"], F.lit(">"), x["dep"], F.lit(":"), x["rel"])
    told = F.transform(features.edges_of(F.col("tokens")), link)
    return known(tokens(spark, sf_dir)).select("sent_id", F.array_join(F.transform("tokens", lambda x: F.concat_ws("/", x["text"], x["xpos"])), " ").alias("words"), F.array_join(told, " ").alias("edges"))


@_query(f"WITH {RULES} SELECT antecedent, decision, confidence FROM rules")
def mined_by_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(mining.mine_with_fpgrowth(line_transactions(spark, sf_dir), SUPPORT, CONFIDENCE))


@_query(
    """WITH tx AS (SELECT doc_id, list_filter(['lang=' || lang, 'source=' || source], lambda x: x IS NOT NULL) AS c FROM documents JOIN labels USING (doc_id) WHERE (lang IS NOT NULL OR source IS NOT NULL) AND (quality IS NOT NULL OR toxic IS NOT NULL)),
sub AS (SELECT DISTINCT array_to_string(list_filter(c, lambda x, i: (m >> (i - 1)) & 1 = 1), '|') AS antecedent, doc_id AS tid FROM tx, range(1, 4) r(m) WHERE len(list_filter(c, lambda x, i: (m >> (i - 1)) & 1 = 1)) > 0)
SELECT antecedent, tid FROM sub"""
)
def itemset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the itemsets of early and of late documents, merged."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    tx = reshape.transactions(rows, "doc_id", ["lang", "source", "quality", "toxic"], ["quality", "toxic"]).filter((F.size("c") > 0) & (F.size("d") > 0))
    halves = [mining.itemset_members(tx.filter(F.col("tid") % 2 == k)) for k in (0, 1)]
    return labelled(mining.merged_members(*halves))
