"""A corpus from raw documents to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import new_path
from tessella.llm.compression import compression_filter
from tessella.llm.curve import pack_along_curve
from tessella.llm.exact import drop_exact_duplicates
from tessella.llm.mixing import mix_documents
from tessella.llm.setsketch import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression ratios lie within their bands.  Null and empty texts go, very
    long ones are judged whole; repeated rows and ties in doc_id are judged each by itself; an
    empty table stays empty; extra columns stay, whatever their names."""
    return compression_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the least doc_id, nulls last, and of several such rows
    the one whose columns have the least hash; one of equal rows.  Null texts all stay; an empty
    table stays empty; extra columns stay, whatever their names."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, chosen as in ``exact_dedup``.  Null texts and
    texts without a word are in no group and stay, very long texts are compared whole; an empty
    table stays empty; extra columns stay, whatever their names."""
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents in the blocks that the mixture draws, with the columns of documents
    alone.  Null and empty texts give none; a null source is one of its own; very long texts run
    over many blocks; repeated rows are drawn as separate ones; an empty table gives none."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of neighbouring documents along the curve.  Null and empty texts give none, very
    long ones full sequences and a rest; repeated rows and doc_ids are packed each for itself; an
    empty table gives none; other columns don't matter."""
    return pack_along_curve(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: SQL has neither zstandard nor a tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = new_path(spark, f"stage-{at}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
