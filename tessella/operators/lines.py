"""Line scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(content: Column, normalize: bool = True) -> Column:
    """Lines of a text, trailing empty ones included; with ``normalize`` CRLF and CR end lines too."""
    return F.split(F.regexp_replace(content, "\r\n?", "\n") if normalize else content, "\n", -1)


def explode_lines(docs: DataFrame, content: str = "content", keep: str | None = None, normalize: bool = True, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, text) of every line, or of those that match the regular expression ``keep``,
    with the columns ``beside`` of their documents.

    Lines that don't match are dropped inside the array, before it is exploded: only matching ones
    become rows.
    """
    numbered = F.transform(split_lines(F.col(content), normalize), lambda text, i: F.struct((i + 1).alias("line"), text.alias("text")))
    if keep:
        numbered = F.filter(numbered, lambda x: F.regexp_like(x["text"], F.lit(keep)))
    return docs.select("doc_id", *beside, F.explode(numbered).alias("l")).select("doc_id", *beside, "l.line", "l.text")
