"""The documents of a corpus made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

1. language_id: documents without a letter, or without a language of probability 0.5, go
2. ngram_join: one document of each group of near copies stays, that of the least id
3. decontamination: documents that leak a benchmark item go
4. pii: validated numbers, dates, addresses and secrets become pseudonyms
5. packing: what is left is tokenized and packed into windows of 1024 ids

Defined results, each stage on what its predecessor kept: a null or empty text, or one without a
letter, goes at the first stage; of repeated rows, as of documents with equal text, one stays; of equal
ids each row is a document of its own until its text decides; of several documents with the least id
the one whose text has the least hash stays; a null label does not matter, as no stage but the first
reads it, to learn from; texts of any length are read whole; an empty table gives an empty one; more
columns, whatever their names, are carried to the last stage; an empty benchmark takes nothing out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from focalis.deploy import ship
from focalis.llm import decontaminate, langid, ngram_join, packing, pii
from focalis.llm.queries import PII_KEY
from focalis.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs.filter(~langid.fold())))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", near_copies),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Hashed models, path sampling and tokenization have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
