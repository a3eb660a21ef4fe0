"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.compression import compression_quality
from tessella.llm.curve import pack_along_curve
from tessella.llm.exact import exact_duplicates
from tessella.llm.htmlblocks import extract_text
from tessella.llm.knlm import perplexities
from tessella.llm.mixing import mix_blocks
from tessella.llm.nbsvm import quality_scores
from tessella.llm.setsketch import near_duplicates
from tessella.llm.tokenstore import write_tokens
from tessella.llm.warc import distinct_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_blocks(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pages(_table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(_table(spark, sf_dir, "documents"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_warc, op3_token_store, op4_exact_dedup, op5_html_extraction, op6_curve_packing, op7_compression_quality, op8_near_dedup, op9_lm_scoring, op10_quality_classifier)}

ORACLE_SQL = {
    "op2_warc": """
        SELECT page_id, url, sha256(html) AS digest, html FROM (
          SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id, url) AS rn
          FROM pages WHERE html IS NOT NULL) WHERE rn = 1""",
    "op4_exact_dedup": """
        SELECT doc_id, duplicate_of, full_hash FROM (
          SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of, sha256(text) AS full_hash,
                 row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
          FROM documents WHERE text IS NOT NULL) WHERE rn > 1""",
}
