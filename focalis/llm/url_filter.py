"""URL rules by host suffix and path prefix, joined on hash prefixes (operator 8).

A rule is a host, a path and an action. It fits its host and all subdomains, if the path of the
URL starts with the rule's. Each distinct pair of host and path is expanded into the expressions
that a rule could have: every suffix of the host of as many labels as some rule has, with every
prefix of the path of a length that some rule has. The first four bytes of an expression's SHA-256 are joined with
those of the rules; the full digest confirms. Of the rules that fit, the longest wins; between
equally long ones that with the longer host, then ``block``. Rules are broadcast if there are at
most ``BROADCAST_RULES`` of them, else the join shuffles.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule
with a host fits; without a rule the verdict is ``default``; rules that are null in host or
action are ignored, a null path is empty; the same rule given twice with both actions blocks;
repeated rows are judged alike; URLs of any length and hosts of any number of labels are
expanded whole, empty labels included, each distinct host and path once; other columns, whatever
their names, stay, but for host, path, rule and verdict, which are replaced; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused

BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(full: Column) -> Column:
    """The first four bytes of a digest in hexadecimal, as a number."""
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict in place of any columns of these names."""
    ready = rules.filter("host is not null and action is not null").select(
        F.translate("host", UPPER, LOWER).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path"), "action"
    )
    ready = ready.groupBy("_rule_host", "_rule_path").agg(F.max("action").alias("_action"))  # block comes after allow
    ready = ready.withColumn("_full", digest(F.col("_rule_host"), F.col("_rule_path"))).withColumn("_short", short(F.col("_full")))
    lengths = sorted(r[0] for r in ready.select(F.length("_rule_path")).distinct().collect())
    counts = sorted(r[0] for r in ready.select(F.size(F.split("_rule_host", r"\."))).distinct().collect())
    if ready.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        ready = F.broadcast(ready)

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    held = unused("_best", kept)
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    held_by = F.filter(F.array(*(F.lit(n) for n in counts)).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(held_by, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = urls.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    tried = tried.withColumn("_tried", digest(F.col("_suffix"), F.col("_prefix"))).withColumn("_short", short(F.col("_tried")))
    fits = tried.join(ready, "_short").filter(F.col("_tried") == F.col("_full"))
    rank = F.struct(F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"), "_action")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_rule_host", "_rule_path").alias("rule"), "_action"), rank).alias(held))
    return rows.join(best, ["host", "path"], "left").select(
        *(F.col(f"`{c}`") for c in kept), "host", "path", F.col(held)["rule"].alias("rule"), F.coalesce(F.col(held)["_action"], F.lit(default)).alias("verdict")
    )
