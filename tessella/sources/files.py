"""Documents from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """The lower-case extension; a bare dot file has none."""
    return F.lower(F.regexp_extract(path, r"[^/]+\.([^./]+)\z", 1))


def read_documents(spark: SparkSession, paths: str | list[str], recursive: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """(doc_id, path, ext, file_name, content) of whole UTF-8 files.

    ``extensions`` become a glob, so other files aren't even opened.  Files and folders whose names start
    with a dot are skipped, which includes bare dot files: they have no extension anyway.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(sorted({e for x in extensions for e in (x.lower(), x.upper())})) + "}")
    files = reader.text(paths, wholetext=True).select(F.url_decode(F.regexp_replace(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")), "^file:/*", "/")).alias("path"), F.col("value").alias("content"))
    shown = files.where(~F.regexp_like("path", F.lit(r"/\.[^/]+/"))) if recursive else files
    return shown.select(F.col("path").alias("doc_id"), "path", extension(F.col("path")).alias("ext"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
