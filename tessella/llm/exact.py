"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each stage counts a narrow key of the rows that the stage before left, with partial sums before
the shuffle, and passes on which keys are shared.  That goes back to the scan as a bitmap of key
hashes, of bounded size whatever the input: a row whose bit isn't set is certainly alone, and one
whose bit is set by another key costs one more hash and falls out at the next count.  So at every
size no text is shuffled to be judged, and the next, dearer hash is taken of survivors only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import KeyFilter, packed, pick, sized, unpacked, written

PREFIX_CHARS = 256
#: Originals (rows of about 150 bytes) up to this number are broadcast, others joined by shuffle.
BROADCAST_ROWS = 200_000


def _shared(keys: DataFrame) -> KeyFilter:
    """A filter of the keys that more than one row has."""
    return KeyFilter(written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "exact-keys"))


def _prefix(prefix_chars: int) -> Column:
    return F.xxhash64(F.octet_length("text"), F.substring("text", 1, prefix_chars))


def refined(docs: DataFrame, rows: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``rows`` (text and more) with what each stage finds among ``docs``: ``by_length`` and
    ``by_prefix`` tell whether the row survives it, ``full`` is the SHA-256 of a survivor's whole
    text and null for others; ``size`` is the length in bytes.  Null texts survive nothing."""
    texts = pick(docs, "text").where("text is not null")
    length = F.xxhash64(F.octet_length("text"))
    of_length = _shared(texts.select(length.alias("key")))
    left = of_length.keep(texts, length)
    of_prefix = _shared(left.select(_prefix(prefix_chars).alias("key")))
    marked = of_length.mark(rows, "by_length", F.when(F.col("text").isNotNull(), length))
    marked = of_prefix.mark(marked, "by_prefix", F.when(F.col("by_length"), _prefix(prefix_chars)))
    return marked.withColumn("size", F.octet_length("text")).withColumn("full", F.when(F.col("by_prefix"), F.sha2("text", 256)))


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Copies: (doc_id, duplicate_of, full_hash) for each row whose text an earlier row has.

    ``duplicate_of`` is the smallest doc_id with that text (null ids come last); one row of it is
    the original and has no row here, but a repeated row of the same doc_id has one, of (doc_id,
    doc_id).  Empty texts are equal to each other.  A null text is a copy of nothing.  Very long
    texts are hashed whole, like others.  Other columns don't matter.  An empty table gives no rows.

    A text that a third of all rows have is no hot key: originals are found by partial minima and
    joined back to narrow rows.
    """
    rows = refined(docs, pick(docs, "doc_id", "text"), prefix_chars).where("full is not null")
    copies = written(rows.select("doc_id", "size", "full", F.monotonically_increasing_id().alias("at")), "exact-survivors")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "at")
    first = copies.groupBy("full", "size").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = copies.join(sized(written(first, "exact-originals"), BROADCAST_ROWS), ["full", "size"])
    return found.where("at <> first.at").select("doc_id", F.col("first.doc_id").alias("duplicate_of"), F.col("full").alias("full_hash"))


def drop_exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each text: that of the smallest doc_id (nulls last), of several
    such rows the one whose columns have the smallest hash.  Rows with a null text all stay.
    Extra columns stay as they are, also with clashing names; an empty table gives no rows.

    Rows that are alone by length or prefix pass without a shuffle.  Copies are judged by narrow
    rows; only where the original itself is repeated its rows come together, after partial ones.
    """
    rows = refined(docs, packed(docs, "doc_id", "text", hashes=("hash",)), prefix_chars)
    alone = rows.where("full is null")
    copies = rows.where("full is not null").drop("text")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash")
    counted = copies.groupBy("full", "size", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = written(counted.groupBy("full", "size").agg(F.min(order).alias("first"), F.min_by("n", order).alias("n"), F.sum("n").alias("all")).where("all > 1"), "exact-originals")
    judged = copies.join(sized(first, BROADCAST_ROWS), ["full", "size"], "left").where("first is null or (hash = first.hash and doc_id <=> first.doc_id)")
    kept = alone.select("row").unionByName(judged.where("n is null or n = 1").select("row"))
    if not first.where("n > 1").isEmpty():
        kept = kept.unionByName(judged.where("n > 1").groupBy("full", "size").agg(F.first("row").alias("row")).select("row"))
    return unpacked(kept, docs)
