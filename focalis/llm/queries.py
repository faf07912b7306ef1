"""What ``__spark_entry__.py`` registers of this subpackage: one query an operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bitpack, decontaminate, html_extract, langid, ngram_join, packing, pii, url_filter, warc

PII_KEY = "a key of the deployment"  # callers pass their own secret

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, best_overlap of each document."""
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by pseudonyms, and how many values changed."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, found="n_replaced")


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the packed files."""
    found = bitpack.token_files(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of each document."""
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_query
def op7_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, class_id, is_query, match_class, offset, bit_error, frames: each vector of ``embeddings`` as a recording."""
    prints = audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.tones)
    return audio.search(prints).withColumnRenamed("id", "vec_id")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op8_url_filter"] = """
WITH rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
    SELECT row_number() OVER () AS n, page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path, CASE WHEN rhost IS NOT NULL THEN rhost || rpath END AS rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) = 1
"""


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL["op9_warc"] = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest AS digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM rows LEFT JOIN firsts ON payload_digest = digest
"""


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.train(documents.filter(~langid.fold())))
