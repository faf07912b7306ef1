"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset on one machine, as in tests, a folder beside the warehouse is used and set.

    A cluster has to name the folder, as nothing else tells which paths all its machines see.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        there = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if "://" not in there and not there.startswith("file:"):
            there = "file://" + there
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: what follows does not depend on how they were made."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        there = _plain_path(shared_dir(spark))
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if _plain_path(folder).startswith(f"{there}/"):
                remove(spark, folder)


def _plain_path(uri: str) -> str:
    return re.sub(r"^file:/+", "/", uri)


def unused(name: str, columns: list[str]) -> str:
    """A column name that a table does not have yet, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, as Spark sees it, and the path in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _hadoop(spark, path)
    return store.exists(there)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    store, there = _hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(there)) if store.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    store, there = _hadoop(spark, path)
    store.delete(there, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file written by the driver, in whatever store the path names."""
    store, there = _hadoop(spark, path)
    out = store.create(there, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
