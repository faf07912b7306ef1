"""How often the gold word is among the first k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def padded(predictions: DataFrame, sentences: DataFrame, k: int) -> DataFrame:
    """sent_id, rank, word: exactly k rows a sentence, missing words as empty strings."""
    slots = sentences.select("sent_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(predictions, ["sent_id", "rank"], "left").withColumn("word", F.coalesce("word", F.lit("")))


def hits(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """sent_id, w, hit: the first rank of the gold word, or null. ``gold``: sent_id, word and a weight w if there is one."""
    truth = gold.select("sent_id", F.col("word").alias("_gold"), (F.col("w") if "w" in gold.columns else F.lit(1).cast("long")).alias("w"))
    truth = truth.withColumn("_gold", F.when(F.col("_gold") != "", F.col("_gold")).otherwise(F.raise_error(F.lit("a gold word is empty")).cast("string")))
    found = truth.join(predictions, (truth["sent_id"] == predictions["sent_id"]) & (F.col("_gold") == F.col("word")), "left")
    return found.groupBy(truth["sent_id"], "_gold", "w").agg(F.min("rank").alias("hit"))


def cumulative_accuracy(predictions: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """k, total, correct, accuracy for 1 to k; the accuracy of no sentences is null."""
    at = hits(predictions, gold).select("w", "hit", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    sums = at.groupBy("k").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("hit") <= F.col("k"), F.col("w")).otherwise(0)).alias("correct"))
    return sums.withColumn("accuracy", F.col("correct") / F.col("total"))
