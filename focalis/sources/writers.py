"""Writers of feature tables, cleaned sentences and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.items import item_text, label, rounded
from ..operators.datasets import numbered
from ..operators.reshape import pivot_last_wins


def export_wide(long: DataFrame, key: str, path: str, names: list[str] | None = None) -> DataFrame:
    """Pivot a long table (key, ord, name, value), write it, and return it."""
    wide = pivot_last_wins(long, key, names)
    write_table(wide, path)
    return wide


def write_table(df: DataFrame, path: str) -> None:
    """By the path's ending: CSV with a header, JSON lines, xlsx, or Parquet."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif ending in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif ending == "xlsx":
        from .xlsx import write_xlsx

        write_xlsx(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def renumbered(df: DataFrame, order: list[str], id_: str = "id") -> DataFrame:
    """Ids 1 to n in the given order."""
    kept = df.drop(id_) if id_ in df.columns and id_ not in order else df
    out = numbered(kept, order, "_n")
    return out.withColumn(id_, F.col("_n") + 1).drop("_n")


def jsonable(value: Column, kind: T.DataType, sets: bool = False) -> Column:
    """A value of any type in a form that ``to_json`` writes whole: keys of maps become strings, at any depth.

    A key that is an item is written as its text, any other struct or array as JSON, the rest as
    text. With ``sets`` arrays are sets: each member once, in order.
    """
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: jsonable(x, kind.elementType, sets))
        return F.array_sort(F.array_distinct(inner)) if sets else inner
    if isinstance(kind, T.StructType):
        made = F.struct(*(jsonable(value[f.name], f.dataType, sets).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.MapType):

        def key(k: Column) -> Column:
            if isinstance(kind.keyType, T.StructType) and kind.keyType.names == ["name", "value"]:
                return item_text(k)
            if isinstance(kind.keyType, (T.StructType, T.ArrayType)):
                return F.to_json(k)
            return k.cast("string")

        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(key(e["key"]).alias("key"), jsonable(e["value"], kind.valueType, sets).alias("value"))))
    return value


def json_lines(df: DataFrame, sets: bool = False) -> DataFrame:
    """value: each row as a JSON object, with values of any type; null columns are left out."""
    return df.select(F.to_json(F.struct(*(jsonable(F.col(f"`{f.name}`"), f.dataType, sets).alias(f.name) for f in df.schema))).alias("value"))


def write_json_array(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of files that each hold one JSON array of some rows; with ``single`` one file, written by one task as a stream.

    Parts without rows write an empty array.
    """
    lines = json_lines(df)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                out.append(mark + x)
                mark = ","
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], names=["value"])

    (lines.coalesce(1) if single else lines).mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def cleaned_json(items: Column, words: Column, id_: Column) -> Column:
    """An entry of the cleaned file: ``{"id", "data": {"set", "dict"}}``; sets as lists, keys as strings."""
    data = F.struct(F.array_sort(items).alias("set"), words.alias("dict"))
    return F.to_json(F.struct(id_.alias("id"), data.alias("data")))


def rule_lines(rules: DataFrame) -> DataFrame:
    """antecedent, decision, support, confidence as text: items as tuples, ratios with ten decimals."""
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("antecedent"), item_text), ", "), F.lit("]"))
    return rules.select(items.alias("antecedent"), item_text(F.col("decision")).alias("decision"), *(rounded(F.col(c)).cast("decimal(38,10)").cast("string").alias(c) for c in ("support", "confidence")))


def index_lines(postings: DataFrame) -> DataFrame:
    """item, n_rules, rules: the inverted index as text, a row an item; its rules in text order, a line feed between them.

    For display: an item that very many rules hold has a long text.
    """
    one = F.concat_ws(" -> ", label(F.col("antecedent")), F.concat_ws("=", "decision.name", "decision.value"))
    rows = postings.select(F.concat_ws("=", "item.name", "item.value").alias("item"), one.alias("rule"))
    return rows.groupBy("item").agg(F.count("*").alias("n_rules"), F.array_join(F.sort_array(F.collect_list("rule")), "\n").alias("rules"))


def processed_path(path: str) -> str:
    """``base_processed.ext`` for ``base.ext``."""
    base, ending = re.fullmatch(r"(.*?)(\.[^./]*)?", path, re.S).groups()
    return f"{base}_processed{ending or ''}"


def stamped_path(path: str, at: datetime | None = None) -> str:
    """The path with ``_YYYYmmdd_HHMMSS`` before its ending."""
    base, ending = re.fullmatch(r"(.*?)(\.[^./]*)?", path, re.S).groups()
    return f"{base}_{at or datetime.now():%Y%m%d_%H%M%S}{ending or ''}"


def write_pair(df: DataFrame, wide: DataFrame, folder: str, name: str, ending: str = "parquet") -> None:
    """A data set twice: ``wide`` as a table (Parquet, or xlsx where it is small) and ``df`` as JSON arrays."""
    write_table(wide, f"{folder}/{name}.{ending}")
    write_json_array(df, f"{folder}/{name}.json")
