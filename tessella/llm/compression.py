"""Quality rule by compression: zstandard ratios within bands that depend on length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import packed, pick, unpacked

LEVEL = 3
CHUNK_BYTES = 2048
#: (bytes up to, least ratio, greatest ratio).  Short texts carry the frame's overhead and have
#: had little to repeat; prose compresses the better the longer it is.  Below 128 bytes even noise
#: is no larger than prose, so only repetition tells.
BANDS = ((32, 0.0, 1.6), (64, 0.0, 1.9), (128, 0.0, 2.2), (256, 0.6, 3.0), (512, 1.1, 3.0), (1024, 1.2, 3.2), (4096, 1.35, 4.0), (16384, 1.5, 5.0), (65536, 1.6, 6.0), (1 << 62, 1.6, 8.0))
#: Band of a chunk, and the greatest share of a text's chunks outside of it.
CHUNK_BAND = (1.3, 4.0)
CHUNK_SHARE = 0.3
SCHEMA = "n_bytes long, ratio double, n_chunks int, repetitive_chunks int, incompressible_chunks int, reason string"


@lru_cache(maxsize=4)
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for upto, lo, hi in bands if n_bytes < upto)


def measure(text: str | None, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES, bands=BANDS, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE) -> tuple:
    """The values of ``SCHEMA`` for one text."""
    if text is None:
        return (None, None, 0, 0, 0, "null")
    raw = text.encode("utf-8", "replace")
    if not raw:
        return (0, None, 0, 0, 0, "empty")
    squeeze = _compressor(level).compress
    ratio = len(raw) / len(squeeze(raw))
    chunks = -(-len(raw) // chunk_bytes) if len(raw) > chunk_bytes else 0
    high = low = 0
    for i in range(chunks):
        start = min(i * chunk_bytes, len(raw) - chunk_bytes)  # the last chunk ends with the text
        r = chunk_bytes / len(squeeze(raw[start : start + chunk_bytes]))
        high += r > chunk_band[1]
        low += r < chunk_band[0]
    least, most = band(len(raw), bands)
    reason = "repetitive" if ratio > most else "incompressible" if ratio < least else "repetitive chunks" if high > chunk_share * chunks else "incompressible chunks" if low > chunk_share * chunks else None
    return (len(raw), ratio, chunks, high, low, reason)


def _measured(options: dict):
    @F.pandas_udf(SCHEMA)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for texts in batches:
            out = pd.DataFrame([measure(t, **options) for t in texts], columns=names)
            yield out.astype({"n_bytes": "Int64", "n_chunks": np.int32, "repetitive_chunks": np.int32, "incompressible_chunks": np.int32, "ratio": float})

    return measured


def compression_quality(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, ratio, n_chunks, repetitive_chunks, incompressible_chunks, reason, keep)
    for each row, with ``keep`` false where a ratio lies outside its band.

    Whole texts are compressed, and chunks of ``chunk_bytes`` that cover all of a longer text, the
    last one ending with it.  Null and empty texts are rejected with reasons "null" and "empty".
    Each row is judged by itself, so repeated rows get equal results.  Very long texts are taken
    whole; an empty table gives no rows; other columns don't matter.  ``options`` are those of
    ``measure``.
    """
    rows = pick(docs, "doc_id", "text").withColumn("m", _measured(options)("text"))
    return rows.select("doc_id", "m.*", F.col("m.reason").isNull().alias("keep"))


def compression_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``compression_quality`` keeps, with all of their columns, clashing
    names included; repeated rows stay or go together, and an empty table stays empty."""
    rows = packed(docs, "text").withColumn("m", _measured(options)("text"))
    return unpacked(rows.where("m.reason is null"), docs)
