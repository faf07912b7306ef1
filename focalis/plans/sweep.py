"""Parameter sweeps: counts are mined once, at the lowest threshold, and every cell of the grid is a filter of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, mining
from ..store import written


@dataclass(frozen=True)
class Grid:
    """Fixed values of one experiment: supports and confidences (first, last, step), and how many words count."""

    supports: tuple[int, int, int]
    confidences: tuple[int, int, int]  # in hundredths
    k: int

    def cells(self) -> list[tuple[int, float]]:
        return [(s, c / 100) for s in range(self.supports[0], self.supports[1] + 1, self.supports[2]) for c in range(self.confidences[0], self.confidences[1] + 1, self.confidences[2])]


#: Fixed values.
EXPERIMENTS = {
    "experiment_1": Grid((20, 70, 5), (20, 85, 5), 1),
    "experiment_2": Grid((5, 30, 5), (5, 45, 5), 5),
    "experiment_3": Grid((20, 70, 5), (20, 85, 5), 5),
    "experiment_4": Grid((20, 70, 5), (20, 85, 5), 5),
    "experiment_5": Grid((5, 30, 5), (5, 30, 5), 5),
    "experiment_6": Grid((5, 50, 5), (5, 50, 5), 1),
}


def cells(spark: SparkSession, grid: list[tuple[int, float]]) -> DataFrame:
    """experiment_id (from 1), min_support, min_confidence of each cell, supports in the outer loop."""
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(grid, 1)], "experiment_id int, min_support long, min_confidence double")


def swept_rules(counts: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """The rules of every cell: ``counts`` have to reach down to the lowest support. Each count meets the few cells it is in."""
    held = F.array(*(F.struct(F.lit(i).alias("experiment_id"), F.lit(s).cast("long").alias("min_support"), F.lit(c).alias("min_confidence")) for i, (s, c) in enumerate(grid, 1)))
    ready = counts.withColumns({"support": F.col("n_ad") / F.col("n"), "confidence": F.col("n_ad") / F.col("n_a")})
    inside = F.filter(held, lambda g: (F.col("n_ad") > g["min_support"]) & (F.col("n_a") > g["min_support"]) & (F.col("confidence") > g["min_confidence"]))
    return ready.select("*", F.inline(inside))


def swept_accuracy(counts: DataFrame, grid: list[tuple[int, float]], sentences: DataFrame, candidates: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """experiment_id, min_support, min_confidence, k, total, correct, accuracy, with one matching of all rules for the whole sweep."""
    low = (min(s for s, _ in grid), min(c for _, c in grid))
    matches = lookup.match_by_counting(sentences, mining.rules(counts, *low))
    best = matches.join(mining.rules(counts, *low).select("antecedent", "decision", "n_ad", "n_a", "n"), ["antecedent", "decision"])
    in_cells = swept_rules(best.drop("support", "confidence"), grid)
    key = F.struct("experiment_id", "sent_id")
    words = lookup.top_words(in_cells.withColumn("sent_id", key), candidates.withColumnRenamed("sent_id", "_s").join(in_cells.select("experiment_id", F.col("sent_id").alias("_s")).distinct(), "_s").withColumn("sent_id", F.struct("experiment_id", F.col("_s").alias("sent_id"))).drop("_s", "experiment_id"), k)
    words = words.select("sent_id.experiment_id", "sent_id.sent_id", "rank", "word")
    # a sentence counts in every cell, also where none of its rules is in that cell
    truth = gold.withColumn("w", F.col("w") if "w" in gold.columns else F.lit(1).cast("long"))
    total = truth.agg(F.sum("w")).scalar()
    hit = words.join(truth.select("sent_id", F.col("word").alias("_gold"), "w"), "sent_id").filter("word = _gold").groupBy("experiment_id", "sent_id", "_gold", "w").agg(F.min("rank").alias("hit"))
    sums = hit.select("experiment_id", "w", F.explode(F.sequence(F.col("hit"), F.lit(k))).alias("k")).groupBy("experiment_id", "k").agg(F.sum("w").alias("correct"))
    every = cells(counts.sparkSession, grid).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    out = every.join(F.broadcast(sums), ["experiment_id", "k"], "left").withColumn("total", total).withColumn("correct", F.coalesce("correct", F.lit(0)).cast("long"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def report(accuracy: DataFrame) -> DataFrame:
    """The columns of the accuracy report; accuracies rounded to ten decimals."""
    return accuracy.select(
        "experiment_id", F.col("min_support").alias("support_value"), "min_confidence", F.col("k").alias("i"), "total", "correct", F.round("accuracy", 10).alias("accuracy")
    ).orderBy("experiment_id", "i")


def timed_lookup(counts: DataFrame, grid: list[tuple[int, float]], sentences: DataFrame) -> DataFrame:
    """Seconds of each cell: min_support, min_confidence, n_rules, n_sentences, step, seconds, per_sentence.

    Steps are ``index build``, ``sequential`` (by containment) and ``indexed`` (by counting). Rules
    and sentences are written before the clock runs, the index in its own step.
    """
    spark = counts.sparkSession
    counts, sentences = written(counts, "timed-counts"), written(sentences, "timed-sentences")
    n_sentences, rows = sentences.count(), []
    n_rules = {(r[0], r[1]): r[2] for r in swept_rules(counts, grid).groupBy("min_support", "min_confidence").count().collect()}  # a row a cell

    def timed(f: Callable):
        began = time.perf_counter()
        out = f()
        return time.perf_counter() - began, out

    for s, c in grid:
        found = mining.rules(counts, s, c)
        build, index = timed(lambda: written(lookup.postings(found), "timed-index"))  # noqa: B023
        sequential, _ = timed(lambda: lookup.match_by_containment(sentences, found).write.format("noop").mode("overwrite").save())  # noqa: B023
        indexed, _ = timed(lambda: lookup.match_by_index(sentences, index).write.format("noop").mode("overwrite").save())  # noqa: B023
        n = n_rules.get((s, c), 0)
        rows += [(s, c, n, n_sentences, step, x, None if step == "index build" else x / max(n_sentences, 1)) for step, x in (("index build", build), ("sequential", sequential), ("indexed", indexed))]
    return spark.createDataFrame(rows, "min_support long, min_confidence double, n_rules long, n_sentences long, step string, seconds double, per_sentence double")


def all_cells() -> list[tuple[int, float]]:
    """The cells of all experiments, each once."""
    return sorted({cell for grid in EXPERIMENTS.values() for cell in grid.cells()})


def experiments_accuracy(counts: DataFrame, sentences: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """experiment and the columns of ``report`` for every cell of every experiment's grid, from one sweep over the cells of all."""
    spark, every = counts.sparkSession, all_cells()
    number = {cell: i for i, cell in enumerate(every, 1)}
    asked = [(name, i, number[cell], k) for name, grid in EXPERIMENTS.items() for i, cell in enumerate(grid.cells(), 1) for k in range(1, grid.k + 1)]
    found = report(swept_accuracy(counts, every, sentences, candidates, gold, max(g.k for g in EXPERIMENTS.values()))).withColumnRenamed("experiment_id", "cell")
    wanted = spark.createDataFrame(asked, "experiment string, experiment_id int, cell int, i int")
    return wanted.join(found, ["cell", "i"]).drop("cell")


__all__ = ["EXPERIMENTS", "Grid", "all_cells", "cells", "experiments_accuracy", "report", "swept_accuracy", "swept_rules", "timed_lookup"]
