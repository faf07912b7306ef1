"""Readers of questions, cleaned sentences and training tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

QUESTION = "id bigint, sentence string, question_word string"


def read_questions(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """A JSON array of questions. A missing path raises FileNotFoundError; malformed files fail when they are read.

    With ``check`` all files are read once beforehand, and malformed ones raise ValueError.
    """
    try:
        df = spark.read.schema(QUESTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    if check:
        try:
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:
            if re.search(r"MALFORMED_RECORD|FAILED_READ_FILE|MalformedInput|CANNOT_PARSE", str(e)):
                raise ValueError(f"malformed JSON in {path}") from e
            raise
    return df


def parse_cleaned(rows: DataFrame, column: str = "value", id_: str | None = None) -> DataFrame:
    """id, items, words from JSON objects ``{"id", "data": {"set": [...], "dict": {...}}}`` in a string column.

    Entries without ``data.set`` or ``data.dict`` are skipped; a set that is no list is empty, as
    is a dict that is no object; malformed text gives no row.
    """
    get = lambda path: F.get_json_object(F.col(column), path)
    members = F.array_distinct(F.coalesce(F.try_variant_get(F.try_parse_json(get("$.data.set")), "$", "array<string>"), F.array().cast("array<string>")))
    words = F.coalesce(F.try_variant_get(F.try_parse_json(get("$.data.dict")), "$", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    key = F.col(id_) if id_ else get("$.id").try_cast("long")
    return rows.filter(get("$.data.set").isNotNull() & get("$.data.dict").isNotNull()).select(key.alias("id"), members.alias("items"), words.alias("words"))


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a file that holds one JSON array; none if the file is malformed."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    return parse_cleaned(whole.select(F.explode(entries).alias("v")).select(F.to_json("v").alias("value")))


def _plain(reader: DataFrameReader, path: str, ending: str) -> DataFrame:
    if ending == "csv":
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return reader.json(path) if ending in ("json", "jsonl") else reader.parquet(path)


def read_table(spark: SparkSession, path: str, rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A training table by its ending: Parquet, CSV (all strings), JSON lines, or xlsx; the first ``rows`` by ``order`` if asked for."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "xlsx":
        from .xlsx import read_xlsx

        df = read_xlsx(spark, path)
    else:
        df = _plain(spark.read, path, ending)
    if rows is None:
        return df
    if not order:
        raise ValueError("the first rows of a table need an order")
    return df.orderBy(*order).limit(rows)


def read_shards(spark: SparkSession, folder: str, name: str = r"train-data-(\d+)\.") -> DataFrame:
    """All training shards of a folder, files or Spark's folders of files in any of the formats of ``read_table``, with the number in the name as ``shard``.

    Those without such a number are left out. Shards need not have the same columns: what one
    lacks is null. Columns that differ in type are read as strings.
    """
    shard = F.regexp_extract("_file", r"/(train-data-[^/]*)(?:/[^/]*)?$", 1)
    number = F.regexp_extract(shard, name, 1)
    try:
        files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/train-data-*").select(F.col("path").alias("_file"))
    except AnalysisException as e:
        raise FileNotFoundError(f"no shards in {folder}") from e
    endings = [r[0] for r in files.filter(number != "").select(F.lower(F.substring_index(shard, ".", -1))).distinct().collect()]
    out = None
    for ending in sorted(endings):
        there = f"{folder.rstrip('/')}/train-data-*.{ending}"
        if ending == "xlsx":
            from .xlsx import read_xlsx

            df = read_xlsx(spark, there, "_file")
        else:
            reader = spark.read.option("mergeSchema", True) if ending == "parquet" else spark.read
            df = _plain(reader, there, ending).withColumn("_file", F.col("_metadata.file_path"))
        df = df.withColumn("shard", F.when(number != "", number.cast("int"))).filter("shard is not null").drop("_file")
        if out is None:
            out = df
            continue
        kinds = {f.name.lower(): f.dataType for f in out.schema}
        odd = [f.name.lower() for f in df.schema if kinds.get(f.name.lower(), f.dataType) != f.dataType]
        text = lambda t: t.select(*(F.col(f"`{c}`").cast("string").alias(c) if c.lower() in odd else F.col(f"`{c}`") for c in t.columns))  # noqa: B023, E731
        out = text(out).unionByName(text(df), allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no shards in {folder}")
    return out


def bundle(train: DataFrame, gold: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Wide training table, gold words and cleaned test sentences, the latter two joined on their ids."""
    return {"train": train, "test": test.join(gold.select("id", F.col("question_word").alias("word")), "id")}
