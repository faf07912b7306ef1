"""Long, wide and encoded forms of categorical records.

Null cells are no items; a null name or value has a null id; repeated rows stay repeated in long
forms and count in weights. Helper columns get names that a table does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import is_decision, item
from ..store import unused
from .datasets import numbered


def unpivot(wide: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """keys, ord, name, value: a row for each cell that is not null, in column order. A projection; nothing is shuffled."""
    columns = [c for c in wide.columns if c not in keys] if columns is None else columns
    cells = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return wide.select(*keys, F.inline(F.filter(cells, lambda x: x["value"].isNotNull())))


def pivot_last_wins(long: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """One row a key, one nullable column a name, in sorted order; of several values the last by ``ord`` (then by value) wins."""
    if names is None:
        names = sorted(r[0] for r in long.select("name").distinct().collect())
    return long.groupBy(key).pivot("name", names).agg(F.max_by("value", F.struct("ord", "value")))


def transactions(wide: DataFrame, tid: str | None, columns: list[str] | None = None, decisions: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """tid, c, d (and w, if a column is named as weight): sorted item arrays of the non-null cells of each row.

    Decision items are those of ``decisions``, or else those whose name says so. A projection.
    """
    columns = [c for c in wide.columns if c != tid] if columns is None else columns
    cells = F.array_sort(F.filter(F.array(*(item(c, F.col(c)) for c in columns)), lambda x: x["value"].isNotNull()))

    def decides(x):
        return is_decision(x["name"]) if decisions is None else x["name"].isin(*decisions)

    head = [F.col(tid).alias("tid")] if tid else [F.lit(None).cast("long").alias("tid")]
    tail = [F.col(weight).alias("w")] if weight else []
    return wide.select(*head, F.filter(cells, lambda x: ~decides(x)).alias("c"), F.filter(cells, decides).alias("d"), *tail)


def weighted_transactions(wide: DataFrame, columns: list[str], decisions: list[str] | None = None) -> DataFrame:
    """tid (null), c, d, w: distinct rows as transactions, and how often they occur.

    Rows are grouped by their plain columns, before any array is built, so only distinct rows pay for that.
    """
    times = unused("_w", columns)
    return transactions(wide.groupBy(*columns).agg(F.count("*").alias(times)), None, columns, decisions, weight=times)


def from_long(long: DataFrame, tid: str) -> DataFrame:
    """tid, c, d from a long table; with several values of a name all are kept."""
    items = F.array_sort(F.collect_set(item(F.col("name"), F.col("value"))))
    rows = long.filter("value is not null").groupBy(F.col(tid).alias("tid")).agg(items.alias("items"))
    return rows.select("tid", F.filter("items", lambda x: ~is_decision(x["name"])).alias("c"), F.filter("items", lambda x: is_decision(x["name"])).alias("d"))


def dictionary(long: DataFrame) -> DataFrame:
    """str, id: one numbering of all names and values, from 0 in the order of their bytes.

    Range partitions are ranked one by one, so no task ranks the whole dictionary or all strings of a kind.
    """
    strings = long.select(F.explode(F.array("name", "value")).alias("str")).filter("str is not null").distinct()
    return numbered(strings, ["str"], "id").select("str", "id")


def encode(long: DataFrame, words: DataFrame) -> DataFrame:
    """Names and values of a long table replaced by their ids (``name_id``, ``value_id``)."""
    names, values = words.select(F.col("str").alias("name"), F.col("id").alias("name_id")), words.select(F.col("str").alias("value"), F.col("id").alias("value_id"))
    return long.join(names, "name", "left").join(values, "value", "left").drop("name", "value")


def decode(coded: DataFrame, words: DataFrame) -> DataFrame:
    """The inverse of ``encode``; ids that the dictionary lacks give null."""
    names, values = words.select(F.col("str").alias("name"), F.col("id").alias("name_id")), words.select(F.col("str").alias("value"), F.col("id").alias("value_id"))
    return coded.join(names, "name_id", "left").join(values, "value_id", "left").drop("name_id", "value_id")
