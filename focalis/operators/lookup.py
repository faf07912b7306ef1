"""Which rules fire for a sentence, and the words they lead to.

A rule fires if its whole antecedent lies in the sentence's condition set. Sentences are
(sent_id, c), each id once; candidate words are (sent_id, item, word, pos). A null or empty
condition set fires nothing, an item that comes twice counts once, and of a word that several
items lead to the best place counts. Without rules or sentences there are no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.items import item_text, label, rounded


def postings(rules: DataFrame) -> DataFrame:
    """The inverted index: item, antecedent, decision, k (items of the antecedent), confidence, support."""
    return rules.select(F.explode("antecedent").alias("item"), "antecedent", "decision", F.size("antecedent").alias("k"), "confidence", "support")


def match_by_counting(sentences: DataFrame, rules: DataFrame) -> DataFrame:
    """sent_id, antecedent, decision, confidence, support of all that fire, by relational division.

    Items are joined with the index and matches counted; equal antecedents are joined once.
    """
    sets = rules.select("antecedent").distinct()
    index = sets.select(F.explode("antecedent").alias("item"), "antecedent", F.size("antecedent").alias("k"))
    items = sentences.select("sent_id", F.explode(F.array_distinct("c")).alias("item"))
    hit = items.join(index, "item").groupBy("sent_id", "antecedent").agg(F.count("*").alias("n"), F.first("k").alias("k")).filter("n = k")
    return hit.select("sent_id", "antecedent").join(rules.select("antecedent", "decision", "confidence", "support"), "antecedent")


def match_by_index(sentences: DataFrame, index: DataFrame) -> DataFrame:
    """The same from ``postings``, as they were written: items are joined with the index and counted for each rule."""
    items = sentences.select("sent_id", F.explode(F.array_distinct("c")).alias("item"))
    hit = items.join(index, "item").groupBy("sent_id", "antecedent", "decision", "confidence", "support", "k").agg(F.count("*").alias("n"))
    return hit.filter("n = k").select("sent_id", "antecedent", "decision", "confidence", "support")


def match_by_containment(sentences: DataFrame, rules: DataFrame) -> DataFrame:
    """The same, by testing containment: joined on the antecedent's first item, so no rule meets a sentence without it."""
    left = sentences.select("sent_id", "c", F.explode(F.array_distinct("c")).alias("_first"))
    right = rules.select("antecedent", "decision", "confidence", "support", F.col("antecedent")[0].alias("_first"))
    return left.join(right, "_first").filter(F.size(F.array_except("antecedent", "c")) == 0).select("sent_id", "antecedent", "decision", "confidence", "support")


def score(confidence: Column | str = "confidence", support: Column | str = "support") -> Column:
    """Confidence times support, each as exported, with ten decimals."""
    return rounded(F.col(confidence) if isinstance(confidence, str) else confidence).cast("double") * rounded(F.col(support) if isinstance(support, str) else support).cast("double")


def ranked_decisions(matches: DataFrame, by: Column | None = None) -> DataFrame:
    """sent_id, decision, best, rank: decisions by their best score, then by their text, both descending."""
    best = matches.groupBy("sent_id", "decision").agg(F.max(score() if by is None else by).alias("best"))
    order = W.partitionBy("sent_id").orderBy(F.desc("best"), F.desc(item_text(F.col("decision"))))
    return best.withColumn("rank", F.row_number().over(order))


def top_words(matches: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """sent_id, rank, word: the first k distinct words in the order of decisions, then of words within one."""
    firsts = ranked_decisions(matches).join(candidates.withColumnRenamed("item", "decision"), ["sent_id", "decision"])
    firsts = firsts.groupBy("sent_id", "word").agg(F.min(F.struct("rank", "pos")).alias("at"))
    order = W.partitionBy("sent_id").orderBy("at", "word")
    return firsts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("sent_id", "rank", "word")


def query(sentences: DataFrame, rules: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """sent_id, words: every sentence with its first k words in order; an empty array if no rule fires."""
    words = top_words(match_by_counting(sentences, rules), candidates, k)
    lists = words.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    return sentences.select("sent_id").join(lists, "sent_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def best_by_confidence(matches: DataFrame) -> DataFrame:
    """sent_id, antecedent, decision, confidence of the surest rule; ties go to the longer, then the later one in text order."""
    order = F.struct(F.col("confidence"), F.size("antecedent"), label(F.col("antecedent")), item_text(F.col("decision")))
    return matches.groupBy("sent_id").agg(F.max_by(F.struct("antecedent", "decision", "confidence"), order).alias("r")).select("sent_id", "r.*")


def overlap_match(words: DataFrame, usable: DataFrame, least: float = 0.21) -> DataFrame:
    """Words grouped by equal decision sets, kept if more than ``least`` of the set is usable for the sentence.

    ``words``: sent_id, word, items; ``usable``: sent_id, items. Larger sets come first.
    """
    groups = words.groupBy("sent_id", F.array_sort(F.array_distinct("items")).alias("items")).agg(F.array_sort(F.collect_set("word")).alias("words"))
    joined = groups.join(usable.select("sent_id", F.col("items").alias("usable")), "sent_id")
    share = F.size(F.array_intersect("items", "usable")) / F.size("items")
    order = W.partitionBy("sent_id").orderBy(F.desc(F.size("items")), label(F.col("items")))
    return joined.filter(F.size("items") > 0).withColumn("share", share).filter(F.col("share") > least).withColumn("rank", F.row_number().over(order)).drop("usable")
