"""Focused association rules: condition set -> one decision.

Transactions are compacted first: equal (c, d) pairs become one row with a weight, and all counts
are sums of weights. Categorical tables repeat heavily, so subsets are only enumerated for
distinct rows. Items at or below the support threshold are taken out before enumeration, which
changes no rule because no set occurs more often than its items.

A run fails on a transaction whose condition or decision set is empty or null. Repeated rows
count as often as they occur; no transactions give no rules. Only the columns c, d and w are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.items import ITEM
from ..store import unused, written

LISTED = 14  # items whose subsets are listed in one array
MAX_ITEMS = 32  # of a condition set after pruning; more would give over four billion subsets a row
MOST_ITEMSETS = 10_000_000  # of distinct rows by FP-growth; beyond that rare ones are cut off as it counts
_PART = 10_000  # times that a row is repeated at once
FEW_ITEMS = 500  # frequent items that are handed to every task as one array; more are joined


def validated(transactions: DataFrame) -> DataFrame:
    """The same rows; a run fails on an empty condition or decision set."""
    return transactions.withColumns({
        "c": F.when(F.size("c") > 0, F.col("c")).otherwise(F.raise_error(F.lit("a transaction has no condition item")).cast("array<struct<name:string,value:string>>")),
        "d": F.when(F.size("d") > 0, F.col("d")).otherwise(F.raise_error(F.lit("a transaction has no decision item")).cast("array<struct<name:string,value:string>>")),
    })


def compact(transactions: DataFrame) -> DataFrame:
    """c, d, w: distinct rows and how often they occur."""
    weight = F.sum("w") if "w" in transactions.columns else F.count("*")
    return transactions.groupBy("c", "d").agg(weight.alias("w"))


def _distinct_rows(transactions: DataFrame, keep: bool = True) -> DataFrame:
    """Compacted transactions, written once for the several counts that read them; nothing stays in the session's cache."""
    rows = compact(validated(transactions))
    return written(rows, "transactions") if keep else rows


def _picked(items: Column, mask: Column) -> Column:
    return F.filter(items, lambda x, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


def _masks(first: int, n: Column) -> Column:
    """The bit masks from ``first`` to that of all n items."""
    last = F.call_function("shiftleft", F.lit(1), n) - 1
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def with_subsets(df: DataFrame, items: str = "c", name: str = "antecedent") -> DataFrame:
    """``df`` with a row for each non-empty subset of an array, in the order of their bit masks.

    Subsets of the first ``LISTED`` items are listed in one array. Each subset of later items, if there
    are any, is a row of its own before that, so that no row grows with the number of all subsets.
    """
    late = unused("_late", [*df.columns, name])
    xs, n = F.col(f"`{items}`"), F.greatest(F.size(F.col(f"`{items}`")), F.lit(0))
    checked = F.when(n <= MAX_ITEMS, F.greatest(n - LISTED, F.lit(0))).otherwise(F.raise_error(F.lit(f"a condition set has more than {MAX_ITEMS} items")).cast("int"))
    rows = df.withColumn(late, F.explode(_masks(0, checked)))
    later = _picked(F.slice(xs, LISTED + 1, MAX_ITEMS - LISTED), F.col(late))
    first = F.when(F.col(late) > 0, 0).otherwise(1)  # the empty subset comes once, and is left out
    listed = F.slice(xs, 1, LISTED)
    early = F.filter(_masks(0, F.least(n, F.lit(LISTED))), lambda m: m >= first)
    both = F.transform(early, lambda m: F.when(F.col(late) > 0, F.concat(_picked(listed, m), later)).otherwise(_picked(xs, m)))
    return rows.withColumn(name, F.explode(both)).drop(late)


def pruned(compacted: DataFrame, min_support: int, few: int = FEW_ITEMS) -> DataFrame:
    """Condition items that occur ``min_support`` times or less taken out, rows compacted again.

    A few frequent items go to every task as an array. Many are joined with the items of the rows;
    Spark broadcasts them or splits hot ones, by size.
    """
    if min_support <= 0:
        return compacted
    items = compacted.select(F.explode("c").alias("x"), "w")
    frequent = items.groupBy("x").agg(F.sum("w").alias("n")).filter(F.col("n") > min_support).select("x")
    found = frequent.limit(few + 1).select("x.name", "x.value").collect()
    if len(found) <= few:
        held = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.value).alias("value")) for r in found)).cast(f"array<{ITEM}>")
        return compact(compacted.select(F.array_sort(F.array_intersect("c", held)).alias("c"), "d", "w"))
    kept = compacted.select("c", "d", "w", F.explode("c").alias("x")).join(frequent, "x")
    return compact(kept.groupBy("c", "d", "w").agg(F.array_sort(F.collect_set("x")).alias("kept")).select(F.col("kept").alias("c"), "d", "w"))


def antecedents(compacted: DataFrame) -> DataFrame:
    """antecedent, d, w: a row for each subset of each distinct condition set."""
    return with_subsets(compacted).select("antecedent", "d", "w")


def itemset_counts(transactions: DataFrame) -> DataFrame:
    """antecedent, n (transactions that contain it), n_decisions (distinct decision items beside it)."""
    rows = antecedents(_distinct_rows(transactions))
    total = rows.groupBy("antecedent").agg(F.sum("w").alias("n"))
    beside = rows.select("antecedent", F.explode("d").alias("x")).distinct().groupBy("antecedent").agg(F.count("*").alias("n_decisions"))
    return total.join(beside, "antecedent")


def itemset_members(transactions: DataFrame) -> DataFrame:
    """antecedent, tid: the transactions that contain each itemset, a row for each pair."""
    return with_subsets(validated(transactions)).select("antecedent", "tid").distinct()


def merged_members(a: DataFrame, b: DataFrame, one: bool = False) -> DataFrame:
    """The members of both, each once; with ``one`` both have to be of one and the same itemset, or ValueError is raised."""
    both = a.unionByName(b).distinct()
    if one and len(both.select("antecedent").distinct().limit(2).collect()) > 1:
        raise ValueError("the members belong to different itemsets")
    return both


def frequent_antecedents(transactions: DataFrame, min_support: int) -> DataFrame:
    """antecedent, n for all that occur more than ``min_support`` times."""
    rows = antecedents(pruned(_distinct_rows(transactions), min_support))
    return rows.groupBy("antecedent").agg(F.sum("w").alias("n")).filter(F.col("n") > min_support)


def rule_counts(transactions: DataFrame, min_support: int = 0, keep: bool = True) -> DataFrame:
    """antecedent, decision, n_ad, n_a, n for all pairs above the threshold: all that any rule above it needs.

    ``keep`` writes the distinct rows once; without it the input is read for each count.
    """
    whole = _distinct_rows(transactions, keep)
    # a mark beside the decisions counts the antecedent itself, so subsets are made once and counted in one pass
    marks = F.concat(F.array(F.struct(F.lit(False).alias("own"), F.lit(None).cast(ITEM).alias("decision"))), F.transform("d", lambda x: F.struct(F.lit(True).alias("own"), x.alias("decision"))))
    rows = antecedents(pruned(whole, min_support).withColumn("d", marks)).select("antecedent", F.inline("d"), "w")
    found = rows.groupBy("antecedent", "own", "decision").agg(F.sum("w").alias("n_ad")).filter(F.col("n_ad") > min_support)
    n_a = F.max(F.when(~F.col("own"), F.col("n_ad"))).over(W.partitionBy("antecedent"))
    counted = found.withColumn("n_a", n_a).filter(F.col("own") & F.col("n_a").isNotNull())
    return counted.select("antecedent", "decision", "n_ad", "n_a").withColumn("n", whole.agg(F.sum("w")).scalar())


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Count tables of two disjoint sets of transactions as one of both; each has to be made with threshold 0.

    Antecedent counts are carried per antecedent, so those that meet no common decision add up too.
    """
    both = old.unionByName(new)
    n_ad = both.groupBy("antecedent", "decision").agg(F.sum("n_ad").alias("n_ad"))
    sides = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    n_a = sides.groupBy("antecedent", "_side").agg(F.max("n_a").alias("n_a")).groupBy("antecedent").agg(F.sum("n_a").alias("n_a"))
    total = sides.groupBy("_side").agg(F.max("n").alias("n")).agg(F.sum("n"))
    return n_ad.join(n_a, "antecedent").withColumn("n", total.scalar())


def rules(counts: DataFrame, min_support: int | Column, min_confidence: float | Column) -> DataFrame:
    """Rules with both counts above ``min_support`` and a confidence above ``min_confidence``, both strictly."""
    ready = counts.withColumns({"support": F.col("n_ad") / F.col("n"), "confidence": F.col("n_ad") / F.col("n_a")})
    return ready.filter((F.col("n_ad") > min_support) & (F.col("n_a") > min_support) & (F.col("confidence") > min_confidence))


def mine_rules(transactions: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """antecedent, decision, n_ad, n_a, n, support (relative), confidence."""
    return rules(rule_counts(transactions, min_support), min_support, min_confidence)


def mine_with_fpgrowth(transactions: DataFrame, min_support: int, min_confidence: float, most: int = MOST_ITEMSETS) -> DataFrame:
    """The same rules by the built-in FP-growth, for comparison: antecedent, decision, confidence as doubles.

    FP-growth knows no weights. So a distinct row is a basket for each binary digit of its weight, with
    the digit as one more item, and what an itemset counts beside each digit is added up: as many
    baskets as distinct rows, times the digits. Nothing rare can be cut off before it is added up, so
    where there might be more than ``most`` itemsets, a row is a basket as often as it occurs instead.
    """
    from pyspark.ml.fpm import FPGrowth

    schema = "k string, name string, value string"
    item = lambda k: lambda x: F.to_json(F.struct(F.lit(k).alias("k"), x["name"], x["value"]))
    rows = pruned(written(compact(transactions), "transactions"), min_support)
    rows = rows.select(F.concat(F.transform("c", item("C")), F.transform("d", item("D"))).alias("items"), F.col("w").cast("long").alias("w"))
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.call_function("shiftright", F.col("w"), j).bitwiseAND(F.lit(1)) == 1)
    n, n_baskets, n_itemsets = rows.agg(F.sum("w"), F.sum(F.size(digits)), F.sum(F.size(digits) * F.pow(F.lit(2.0), F.size("items") + 1))).first()
    if (n_itemsets or 0) <= most:
        baskets = rows.select(F.explode(digits).alias("digit"), "items").select(F.concat("items", F.array(F.col("digit").cast("string"))).alias("items"))
        least = 0.5 / max(n_baskets or 0, 1)
    else:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("w") - 1) / _PART)))
        parts = rows.select("items", "w", part.alias("part")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        baskets = parts.select("items", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(_PART), F.col("w") - F.col("part") * _PART).cast("int")))).select("items")
        least = (min_support + 0.5) / max(n, 1)
    is_digit = lambda x: ~x.startswith("{")
    found = FPGrowth(minSupport=least, minConfidence=0.0).fit(baskets).freqItemsets
    if (n_itemsets or 0) <= most:
        found = found.filter(F.exists("items", is_digit))
        digit = F.filter("items", is_digit)[0].cast("int")
        found = found.select(F.array_sort(F.filter("items", lambda x: ~is_digit(x))).alias("items"), F.call_function("shiftleft", F.col("freq"), digit).alias("freq"))
        found = found.groupBy("items").agg(F.sum("freq").alias("freq"))
    parsed = found.select(F.transform("items", lambda x: F.from_json(x, schema)).alias("xs"), "freq").filter(F.col("freq") > min_support)
    of = lambda k: F.transform(F.filter("xs", lambda x: x["k"] == k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    sides = parsed.select(F.array_sort(of("C")).alias("antecedent"), of("D").alias("ds"), "freq").filter((F.size("antecedent") > 0) & (F.size("ds") <= 1))
    n_a = F.max(F.when(F.size("ds") == 0, F.col("freq"))).over(W.partitionBy("antecedent"))
    rules_ = sides.withColumn("n_a", n_a).filter(F.size("ds") == 1).select("antecedent", F.col("ds")[0].alias("decision"), (F.col("freq") / F.col("n_a")).alias("confidence"))
    return rules_.filter(F.col("confidence") > min_confidence)
