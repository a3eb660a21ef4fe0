"""Packing documents into sequences along a space-filling curve.

A document's hashed token counts are projected to a few dimensions; each coordinate becomes its
rank among quantiles of the whole corpus, and the cell's place on the Hilbert curve is the sort
key.  Documents that are alike lie near each other in that order and share sequences.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pick, written
from tessella.llm.tokens import TOKENIZER, encoder
from tessella.llm.words import mix

SEQUENCE_TOKENS = 2048
DIMENSIONS, BITS = 4, 8
FEATURES = 4096
#: Sequences that are open at a time in a partition; a document goes to the fullest it fits in.
OPEN = 32
_SEQUENCES = "seq long, n_tokens int, doc_ids array<long>, starts array<int>, lengths array<int>, tokens binary"


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(41).standard_normal((FEATURES, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """Coordinates of a document: its signed hashed log counts, of unit length, projected."""
    if not len(ids):
        return np.zeros(DIMENSIONS)
    values, counts = np.unique(ids, return_counts=True)
    h = mix(values.astype(np.uint64) + np.uint64(1))
    vector = np.bincount((h % np.uint64(FEATURES)).astype(np.int64), weights=np.log1p(counts) * np.where(h >> np.uint64(63), 1.0, -1.0), minlength=FEATURES)
    return vector @ _projection() / max(np.linalg.norm(vector), 1e-12)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (rows, coordinates below 2**bits) on the Hilbert curve, after
    Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokenised(tokenizer: str, batches):
    enc = encoder(tokenizer)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), 1024):
            ids = [enc.encode(t) for t in texts[i : i + 1024]]
            points = np.array([project(x) for x in ids]).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1024), *[pa.array(points[:, d].copy()) for d in range(DIMENSIONS)], pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", *[f"y{d}" for d in range(DIMENSIONS)], "ids"])


class _Open:
    def __init__(self):
        self.used, self.parts, self.docs, self.starts, self.lengths = 0, [], [], [], []


def _fill(sequence_tokens: int, tokenizer: str, open_bins: int, batches):
    enc = encoder(tokenizer)
    end = np.array([enc.eot], dtype=enc.dtype)
    base, made, bins, done = TaskContext.get().partitionId() << 40, 0, [], []

    def flush():
        nonlocal made
        rows = [(base + made + i, b.used, b.docs, b.starts, b.lengths, np.concatenate(b.parts).tobytes()) for i, b in enumerate(done)]
        made += len(done)
        done.clear()
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["seq", "n_tokens", "doc_ids", "starts", "lengths", "tokens"])

    def put(doc_id, start, ids):
        room = [b for b in bins if b.used + len(ids) <= sequence_tokens]
        if room:
            best = max(room, key=lambda b: b.used)
        else:
            if len(bins) >= open_bins:
                full = max(bins, key=lambda b: b.used)
                bins.remove(full)
                done.append(full)
            bins.append(best := _Open())
        best.docs.append(doc_id)
        best.starts.append(start)
        best.lengths.append(len(ids))
        best.parts.append(ids)
        best.used += len(ids)
        if best.used == sequence_tokens:
            bins.remove(best)
            done.append(best)

    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.concatenate([np.frombuffer(raw, enc.dtype), end])
            for start in range(0, len(ids), sequence_tokens):
                put(doc_id, start, ids[start : start + sequence_tokens])
            if len(done) >= 256:
                yield flush()
    done += bins
    if done:
        yield flush()


def pack_along_curve(docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, tokenizer: str = TOKENIZER, open_bins: int = OPEN) -> DataFrame:
    """(seq, n_tokens, doc_ids, starts, lengths, tokens): sequences of at most ``sequence_tokens``
    ids.  Entry i of the lists is a part: its document, the first of that document's ids in it
    and their number; ``tokens`` has the parts' packed ids one after another.

    Every document ends with an end-of-text id.  One of more than ``sequence_tokens`` ids is cut
    into full sequences and a rest; all others stay whole.  Parts go, in curve order, to the
    fullest of ``open_bins`` open sequences that has room.  Null and empty texts give nothing.
    Repeated rows and repeated doc_ids are packed as separate documents.  An empty table gives no
    rows; other columns don't matter.
    """
    names = [f"y{d}" for d in range(DIMENSIONS)]
    schema = "doc_id long, " + ", ".join(f"{y} double" for y in names) + ", ids binary"
    points = written(pick(docs, "doc_id", "text").where("text <> ''").mapInArrow(partial(_tokenised, tokenizer), schema), "pack-points")
    quantiles = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = points.agg(*[F.percentile_approx(y, quantiles, 20_000).alias(y) for y in names]).first()
    edges = [np.asarray(cuts[y] or [], dtype=float) for y in names]

    @F.pandas_udf("long")
    def key(*ys: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([np.searchsorted(e, y.to_numpy()) for e, y in zip(edges, ys)], axis=1)))

    keyed = points.select("doc_id", "ids", key(*names).alias("key"))
    ordered = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(partial(_fill, sequence_tokens, tokenizer, open_bins), _SEQUENCES)
