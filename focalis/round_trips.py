"""Registered queries of sources and sinks: each writes with a sink, in the shared folder, and returns what the source reads back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .catalog import DECISION, RECORDS, RULES, SWEEP, _query, document_records, line_table, lines, rules_of, table
from .functions import items as I
from .operators import lookup, reshape
from .plans import pipelines
from .sources import readers, writers
from .store import fresh

STAMP = datetime(2024, 1, 2, 3, 4, 5)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions; every 50th has no word."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit('Which "'), F.col("p_name"), F.lit('" is\nÄ\\?')).alias("sentence"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("question_word"))


@_query("""SELECT p_partkey AS id, 'Which "' || p_name || '" is' || chr(10) || 'Ä\\?' AS sentence, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS question_word FROM part""")
def questions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as files of JSON arrays, checked and read."""
    path = fresh(spark, "questions") + ".json"
    writers.write_json_array(_parts(spark, sf_dir), path)
    return readers.read_questions(spark, path, check=True)


@_query("""SELECT (row_number() OVER (ORDER BY p_name, p_partkey))::BIGINT AS id, 'Which "' || p_name || '" is' || chr(10) || 'Ä\\?' AS sentence, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS question_word FROM part""")
def renumbered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ids from 1 in the order of names, as one file."""
    path = fresh(spark, "renumbered") + ".json"
    writers.write_json_array(writers.renumbered(_parts(spark, sf_dir), ["sentence", "id"]), path, single=True)
    return readers.read_questions(spark, path)


@_query(
    f"""WITH {RECORDS}, x AS (SELECT doc_id, '(''' || name || ''', ''' || value || ''')' AS item, name, value FROM records),
c AS (SELECT doc_id, string_agg(DISTINCT item, '|' ORDER BY item) AS items FROM x WHERE name LIKE 'SENTENCE%' GROUP BY 1),
w AS (SELECT doc_id, string_agg(item || '=' || value, '|' ORDER BY item) AS words FROM x WHERE name NOT LIKE 'SENTENCE%' GROUP BY 1)
SELECT doc_id AS id, items, coalesce(words, '') AS words FROM c LEFT JOIN w USING (doc_id)"""
)
def cleaned_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as cleaned entries (condition items, and the word that each decision item leads to), a file an array, read back entry by entry."""
    rows = document_records(spark, sf_dir).withColumn("item", I.item_text(F.struct("name", "value"))).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(~I.is_decision(F.col("name")), F.col("item")))).alias("set"),
        F.map_from_entries(F.sort_array(F.collect_set(F.when(I.is_decision(F.col("name")), F.struct("item", F.array("value").alias("words")))))).alias("dict"),
    )
    path = fresh(spark, "cleaned") + ".json"
    writers.write_json_array(rows.filter(F.size("set") > 0).select(F.col("doc_id").alias("id"), F.struct("set", "dict").alias("data")), path)
    back = readers.read_cleaned(spark, path)
    words = F.sort_array(F.transform(F.map_entries("words"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))))
    return back.select("id", F.array_join(F.sort_array("items"), "|").alias("items"), F.array_join(words, "|").alias("words"))


@_query(
    """WITH f AS (SELECT unnest(['csv', 'json', 'parquet']) AS format)
SELECT format, c_custkey::VARCHAR AS key, c_name AS name, c_acctbal::VARCHAR AS balance FROM f, (SELECT c_custkey, 'a "' || c_name || '",' || chr(10) || 'b' AS c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18, 2) END AS c_acctbal FROM customer)
UNION ALL SELECT 'xlsx', n_nationkey::VARCHAR, '<' || n_name || ' & Ä>', CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR END FROM nation"""
)
def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in each format, read back as text: customers in those without a limit, nations as a sheet."""
    c = table(spark, sf_dir, "customer")
    wide = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit('a "'), "c_name", F.lit('",\nb')).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("balance"))
    n = table(spark, sf_dir, "nation")
    small = n.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("<"), "n_name", F.lit(" & Ä>")).alias("name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("balance"))
    out = None
    for ending in ("csv", "json", "parquet", "xlsx"):
        path = fresh(spark, "format") + f".{ending}"
        writers.write_table(small if ending == "xlsx" else wide, path)
        back = readers.read_table(spark, path).select(F.lit(ending).alias("format"), *(F.col(x).cast("string") for x in ("key", "name", "balance")))
        out = back if out is None else out.unionByName(back)
    return out


@_query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus, CASE WHEN shard > 2 THEN o_orderpriority END AS o_orderpriority, shard FROM (SELECT *, (o_orderkey % 4 + 1)::INTEGER AS shard FROM orders)")
def folder_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in four shards, two in each of two formats, one of the formats with a column more; other names are passed over."""
    folder, orders = fresh(spark, "shards"), table(spark, sf_dir, "orders")
    for k in range(1, 5):
        own = orders.filter(F.col("o_orderkey") % 4 == k - 1).select("o_orderkey", "o_orderstatus", *["o_orderpriority"][: k > 2])
        writers.write_table(own, f"{folder}/train-data-{k}.{'json' if k > 2 else 'parquet'}")
    writers.write_table(orders.select("o_orderkey"), f"{folder}/train-data-all.parquet")
    return readers.read_shards(spark, folder)


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, CASE WHEN n_regionkey > 2 THEN n_regionkey::VARCHAR END AS region, n_regionkey::INTEGER AS shard FROM nation")
def xlsx_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one sheet a region, of two layouts."""
    folder, nations = fresh(spark, "sheets"), table(spark, sf_dir, "nation")
    for k in [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]:
        own = nations.filter(F.col("n_regionkey") == k)
        own = own.select(F.col("n_regionkey").alias("region"), "n_name", "n_nationkey") if k > 2 else own.select("n_nationkey", "n_name")
        writers.write_table(own, f"{folder}/train-data-{k}.xlsx")
    return readers.read_shards(spark, folder).select("n_nationkey", "n_name", "region", "shard")


@_query(catalog.ORACLE_SQL["txn_pivot_last_wins"])
def pivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "wide") + ".parquet"
    writers.export_wide(document_records(spark, sf_dir), "doc_id", path)
    return readers.read_table(spark, path)


@_query(
    """SELECT side, c_custkey AS key, c_mktsegment AS segment, CASE WHEN side = 'wide' THEN c_acctbal END AS balance FROM customer, (SELECT unnest(['wide', 'json']) AS side)"""
)
def dataset_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set as a table and as JSON."""
    folder, c = fresh(spark, "pair"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    writers.write_pair(c.drop("balance"), c, folder, "customers")
    wide = readers.read_table(spark, f"{folder}/customers.parquet").withColumn("side", F.lit("wide"))
    both = spark.read.option("multiLine", True).json(f"{folder}/customers.json").withColumns({"side": F.lit("json"), "balance": F.lit(None).cast("double")})
    return wide.unionByName(both)


@_query(
    """SELECT n_regionkey, '{"id":' || n_nationkey || ',"data":{"set":["' || n_name || '","x"],"dict":{"(''N'', ''' || n_name || ''')":["a","b"]},"more":{"' || n_regionkey || '":{"true":1}}}}' AS value FROM nation"""
)
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, and maps whose keys are items, numbers and truth values, at several depths, as JSON."""
    n = table(spark, sf_dir, "nation")
    data = F.struct(
        F.array(F.lit("x"), "n_name", F.lit("x")).alias("set"),
        F.create_map(I.item("N", F.col("n_name")), F.array(F.lit("b"), F.lit("a"))).alias("dict"),
        F.create_map("n_regionkey", F.create_map(F.lit(True), F.lit(1))).alias("more"),
    )
    rows = n.select("n_regionkey", F.struct(F.col("n_nationkey").alias("id"), data.alias("data")).alias("v"))
    return rows.select("n_regionkey", F.to_json(writers.jsonable(F.col("v"), rows.schema["v"].dataType, sets=True)).alias("value"))


@_query(SWEEP)
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the sweep as CSV, with the time in its name, read back."""
    path = writers.stamped_path(fresh(spark, "report") + ".csv", STAMP)
    writers.write_table(catalog.QUERIES["sweep_accuracy"](spark, sf_dir), path)
    back = readers.read_table(spark, path)
    kinds = {"experiment_id": "int", "support_value": "long", "min_confidence": "double", "i": "int", "total": "long", "correct": "long", "accuracy": "double"}
    return back.select(*(F.col(c).cast(k) for c, k in kinds.items()))


@_query(
    f"""WITH {RULES}, x AS (SELECT *, '(''' || replace(decision, '=', ''', ''') || ''')' AS d, '[' || array_to_string(list_transform(string_split(antecedent, '|'), lambda y: '(''' || replace(y, '=', ''', ''') || ''')'), ', ') || ']' AS a FROM rules)
SELECT a AS antecedent, d AS decision, printf('%.10f', support) AS support, printf('%.10f', confidence) AS confidence FROM x"""
)
def rule_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as text with ten decimals, written and read back."""
    path = fresh(spark, "rules") + ".csv"
    writers.write_table(writers.rule_lines(rules_of(line_table(spark, sf_dir))), path)
    return readers.read_table(spark, path)


@_query(
    f"""WITH {RULES}, p AS (SELECT unnest(string_split(antecedent, '|')) AS item, antecedent || ' -> ' || decision AS rule FROM rules)
SELECT item, count(*) AS n_rules, string_agg(rule, chr(10) ORDER BY rule) AS rules FROM p GROUP BY 1"""
)
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.index_lines(lookup.postings(rules_of(line_table(spark, sf_dir))))


@_query(
    """SELECT 'train' AS part, doc_id AS id, lang AS word, NULL::INTEGER AS n_items FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'test', doc_id, source, (lang IS NOT NULL)::INTEGER + (source IS NOT NULL)::INTEGER FROM documents ANTI JOIN labels USING (doc_id)"""
)
def train_test_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents for training, the others as cleaned queries with their gold words."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    train = docs.join(labels, "doc_id")
    rest = docs.join(labels, "doc_id", "left_anti")
    test = reshape.transactions(rest, "doc_id", ["lang", "source"], []).select(F.col("tid").alias("id"), F.col("c").alias("items"))
    gold = rest.select(F.col("doc_id").alias("id"), F.col("source").alias("question_word"))
    made = readers.bundle(train, gold, test)
    return made["train"].select(F.lit("train").alias("part"), F.col("doc_id").alias("id"), F.col("lang").alias("word"), F.lit(None).cast("int").alias("n_items")).unionByName(
        made["test"].select(F.lit("test").alias("part"), "id", "word", F.size("items").alias("n_items"))
    )


@_query(
    f"""WITH {catalog.LINES} SELECT o_orderpriority AS priority, count(*) AS n, count(*) / (SELECT count(*) FROM lines) AS share FROM lines GROUP BY 1"""
)
def cleaner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaner in a chain of transformations."""

    class Shares(pipelines.Cleaner):
        def clean(self, questions: DataFrame) -> DataFrame:
            n = questions.agg(F.count("*")).scalar()
            return questions.groupBy(F.col(DECISION).alias("priority")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n)

    return lines(spark, sf_dir).transform(Shares())
