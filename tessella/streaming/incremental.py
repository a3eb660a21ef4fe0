"""Incremental outlines: only documents that are new or changed are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tessella.api import outline
from tessella.functions.text import content_hash


def changed(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose (doc_id, content_hash) isn't among ``seen``."""
    return docs.withColumn("content_hash", content_hash(F.col("content"))).join(seen.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def outline_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Outlines of a stream of documents, appended to ``path``/nodes by micro-batch; hashes of what
    was read go to ``path``/hashes, and a document that comes again unchanged is skipped.

    Assembly needs windows over whole documents, which streams don't allow, so each batch is a
    batch plan.  Rows carry their batch's number, and a batch that runs again replaces its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        try:
            seen = spark.read.parquet(f"{path}/hashes").where(F.col("batch") < number)
        except AnalysisException:  # nothing was written yet
            seen = spark.createDataFrame([], "doc_id string, content_hash string")
        fresh = changed(rows.dropDuplicates(["doc_id", "content"]), seen)
        outline(fresh, **options).write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        fresh.select("doc_id", "content_hash").write.mode("overwrite").parquet(f"{path}/hashes/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
