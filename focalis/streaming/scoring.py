"""Scoring of streamed sentences against static rules, and incremental counts of streamed transactions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.items import item_text
from ..operators import lookup, mining

MAX_RULES = 100_000  # that every task may hold; ``batch_scorer`` joins any number


def score_stream(sentences: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """Each sentence with its k best decisions (decision, score); stateless, without a shuffle.

    The rules are folded into one array, which is why their number is bounded; with more,
    ValueError is raised, and the stream takes ``foreachBatch(batch_scorer(...))``.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; use foreachBatch(batch_scorer(rules, k, sink))")
    packed = rules.select("antecedent", "decision", lookup.score().alias("score"), item_text(F.col("decision")).alias("text"))
    held = packed.agg(F.collect_list(F.struct("score", "text", "decision", "antecedent")).alias("rules")).scalar()
    fired = F.filter("_rules", lambda r: F.size(F.array_except(r["antecedent"], F.col("c"))) == 0)
    # best first, one entry a decision
    ordered = F.reverse(F.array_sort(F.transform(fired, lambda r: F.struct(r["score"].alias("score"), r["text"].alias("text"), r["decision"].alias("decision")))))
    first = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, r: F.when(F.exists(acc, lambda a: a["text"] == r["text"]), acc).otherwise(F.concat(acc, F.array(r))))
    best = F.slice(F.transform(first, lambda r: F.struct(r["decision"].alias("decision"), r["score"].alias("score"))), 1, k)
    return sentences.withColumn("_rules", held).withColumn("best", best).drop("_rules")


def best_decisions(sentences: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """The same for a batch, by joins, whatever the number of rules. ``sent_id`` has to be unique."""
    ranked = lookup.ranked_decisions(lookup.match_by_counting(sentences, rules)).filter(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "decision", "best")))
    best = ranked.groupBy("sent_id").agg(F.transform(ordered, lambda r: F.struct(r["decision"].alias("decision"), r["best"].alias("score"))).alias("best"))
    nothing = F.array().cast("array<struct<decision:struct<name:string,value:string>,score:double>>")
    return sentences.join(best, "sent_id", "left").withColumn("best", F.coalesce("best", nothing))


def batch_scorer(rules: DataFrame, k: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands ``sink`` the scored rows of each micro-batch and its number."""
    return lambda batch, batch_id: sink(best_decisions(batch, rules, k), batch_id)


class IncrementalCounts:
    """Rule counts kept up to date by micro-batches: ``foreachBatch(counts.add)``.

    Each batch leaves the counts of all batches up to its own in a folder of its number, complete
    once Spark has marked it so. A batch that comes again starts from those before it and replaces
    its own, so it counts once; a new process goes on from the newest. The last ``keep`` stay.
    """

    def __init__(self, folder: str, keep: int = 3):
        self.folder, self.keep = folder.rstrip("/"), max(2, keep)

    def _complete(self, spark: SparkSession) -> list[int]:
        found = (re.fullmatch(r"batch-(\d+)", n) for n in store.names_in(spark, self.folder))
        return sorted(int(m[1]) for m in found if m and store.exists(spark, f"{self.folder}/{m[0]}/_SUCCESS"))

    def _read(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/batch-{number:020d}")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        before = [n for n in self._complete(spark) if n < batch_id]
        new = mining.rule_counts(batch, keep=False)
        if before:
            new = mining.merged_counts(self._read(spark, before[-1]), new)
        new.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id:020d}")
        for n in before[: -(self.keep - 1)]:
            store.remove(spark, f"{self.folder}/batch-{n:020d}")

    def current(self, like: DataFrame | SparkSession) -> DataFrame:
        """The counts of all batches so far."""
        spark = like if isinstance(like, SparkSession) else like.sparkSession
        done = self._complete(spark)
        if not done:
            raise ValueError("no batch has been counted")
        return self._read(spark, done[-1])
