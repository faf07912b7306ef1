"""Splits, subsets, shards and comparisons of tables.

Nulls: keys that are null meet nothing; an order puts nulls first. Helper columns get names that a
table does not have. Tables without rows give tables without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import unused, written


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def numbered(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the given order, without one task sorting them all.

    Rows go to range partitions that are sorted one by one and written with their place; the rows
    of earlier partitions, a number each, are added. Counting and numbering thus see the same
    partitions. Rows equal in ``order`` are ordered by a hash of all their columns, which also
    spreads a value that very many rows share; a column of the new name is replaced.
    """
    spark = df.sparkSession
    rows = df.drop(name) if name not in order else df
    tie, place, shift = (unused(n, [*rows.columns, name]) for n in ("_tie", "_place", "_shift"))
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    by = [*map(_column, order), _column(tie)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn(tie, F.xxhash64(*map(_column, plain))).repartitionByRange(n, *by).sortWithinPartitions(*by).drop(tie)
    placed = written(placed.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(_column(place), 33)
    starts, before = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], before - (r["part"] << 33)))
        before += r["n"]
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    # a row for each partition, joined from the left, so that no row can fall out
    key = unused("_part", [*rows.columns, name])
    held = F.broadcast(spark.createDataFrame(starts, f"{key} long, {shift} long"))
    number = F.coalesce(_column(place) + _column(shift), F.raise_error(F.lit("a row lies in no counted partition")).cast("long"))
    return placed.withColumn(key, part).join(held, key, "left").withColumn(name, number).select(*map(_column, rows.columns), _column(name))


def head(df: DataFrame, n: int, row: str = "row_idx") -> DataFrame:
    return df.filter(F.col(row) < n)


def tail(df: DataFrame, start: int, row: str = "row_idx") -> DataFrame:
    return df.filter(F.col(row) >= start)


def gather(df: DataFrame, places: DataFrame, row: str = "row_idx") -> DataFrame:
    """Rows by number, repeats kept. ``places`` has a column of that name."""
    return places.select(row).join(df, row)


def sample_fixed(df: DataFrame, n: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """n rows without replacement, the same for the same seed and rows; a top-n, not a full sort.

    Rows are drawn in the order of MD5 over the seed and the columns ``by`` (all, as JSON, if none
    are named); rows alike in them are drawn in any order.
    """
    parts = [_column(c).cast("string") for c in by] if by else [F.to_json(F.struct(*map(_column, df.columns)))]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))).limit(n)


def keyed_subset(full: DataFrame, part: DataFrame, keys: list[str], row: str = "row_idx") -> DataFrame:
    """Whole rows of ``full`` whose keys occur in ``part``, as often as they occur there, in the order of ``row``.

    Of rows of ``full`` with equal keys the last is taken. Keys are counted in ``part`` before they
    are joined, so a key that fills much of it is one row of the join.
    """
    last, times, i = (unused(x, full.columns) for x in ("_last", "_times", "_i"))
    lasts = full.groupBy(*keys).agg(F.max(row).alias(last)).drop(*[k for k in keys if k == row])
    asked = part.groupBy(*keys).agg(F.count("*").cast("int").alias(times))
    wanted = asked.join(lasts, keys).select(_column(last), _column(times))
    found = full.join(wanted, _column(row) == _column(last))
    return found.withColumn(i, F.explode(F.sequence(F.lit(1), _column(times)))).select(*map(_column, full.columns)).orderBy(row)


def unmatched(part: DataFrame, *known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``part`` whose keys none of the other tables has."""
    for other in known:
        part = part.join(other.select(*keys).distinct(), keys, "left_anti")
    return part


def cumulative_shards(df: DataFrame, drop: int, shards: int, total: int, row: str = "row_idx", seed: int | None = None) -> DataFrame:
    """dataset 1 to ``shards``: rows after the first ``drop``, in equal chunks; dataset i holds chunks 1 to i.

    Rows beyond the last full chunk are left out. With a seed ``place`` permutes each chunk.
    """
    step = (total - drop) // shards
    chunk = F.floor((F.col(row) - drop) / step).cast("int")
    rows = df.filter(F.col(row) >= drop).withColumn("chunk", chunk).filter(F.col("chunk") < shards)
    if seed is not None:
        rows = rows.withColumn("place", F.xxhash64(F.lit(seed), row))
    return rows.withColumn("dataset", F.explode(F.sequence(F.col("chunk") + 1, F.lit(shards))))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other: side (``left`` or ``right``) and the columns."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def differences_in_order(a: DataFrame, b: DataFrame, row: str = "row_idx") -> DataFrame:
    """row, columns: the rows, by number, at which two tables of the same columns differ, and which columns do.

    Null equals null and NaN equals NaN; a row that one table lacks differs in all columns.
    """
    columns = [c for c in a.columns if c != row]
    left = a.select(_column(row).alias("row"), F.struct(*map(_column, columns)).alias("l"))
    right = b.select(_column(row).alias("row"), F.struct(*map(_column, columns)).alias("r"))
    both = left.join(right, "row", "full")
    one = F.col("l").isNull() | F.col("r").isNull()
    unlike = F.array(*(F.when(one | ~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")), F.lit(c)) for c in columns)) if columns else F.array().cast("array<string>")
    return both.select("row", F.filter(unlike, lambda c: c.isNotNull()).alias("columns")).filter(F.size("columns") > 0)


def equal(a: DataFrame, b: DataFrame, row: str | None = None) -> bool:
    """Whether two tables have the same columns, types and rows: in any order, or in that of a column of row numbers."""
    if a.dtypes != b.dtypes:
        return False
    return not (difference(a, b) if row is None else differences_in_order(a, b, row)).take(1)
