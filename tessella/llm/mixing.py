"""Mixing sources to target weights.

Tokens of each source are packed into blocks of a fixed length.  Each output shard draws how many
of its slots each source gets from a multinomial; the k-th slot that a source gets overall maps
through a pseudorandom permutation of the source's block indices (another one in each epoch), and
blocks are joined to slots by index.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import pick, written
from tessella.llm.tokens import TOKENIZER, encoder
from tessella.llm.words import mix

BLOCK_TOKENS = 2048
SHARD_SLOTS = 256
#: Default weights are tokens to this power.
TEMPERATURE = 0.7
SEED = 17
#: Sources are listed on the driver and in each draw; more than this many are an error, not cut off.
MAX_SOURCES = 65_536
_GROUP = 128  # shards whose draws one row stands for
_TAILS = 4096  # input splits whose last blocks are brought together
_SPAN = 4096  # block indices in a bucket of the range join
_SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("lang", pa.string()), ("text", pa.string())])
_BLOCKS = "pid int, source string, at long, n_tokens int, tokens binary, segments array<struct<doc_id: long, start: int, n_tokens: int, lang: string, text: string>>"


class _Packer:
    """The open block of one source within a task."""

    def __init__(self, size: int, eot: int, dtype: np.dtype):
        self.size, self.dtype, self.end = size, dtype, np.array([eot], dtype=dtype)
        self.parts: list[np.ndarray] = []
        self.segments: list[dict] = []
        self.used = self.count = 0

    def close(self) -> tuple[int, int, bytes, list[dict]]:
        pad = np.repeat(self.end, self.size - self.used)
        row = (self.count, self.used, np.concatenate([*self.parts, pad]).tobytes(), self.segments)
        self.parts, self.segments, self.used, self.count = [], [], 0, self.count + 1
        return row


def _cuts(raw: bytes, lengths: np.ndarray, at: list[int]) -> list[str]:
    """Texts between the token positions ``at``, cut where a character starts."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    marks = []
    for i in at:
        b = int(ends[i])
        while 0 < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        marks.append(b)
    for a, b in zip(marks, marks[1:]):
        out.append(raw[a:b].decode("utf-8", "replace"))
    return out


def _pack(block_tokens: int, tokenizer: str, with_text: bool, batches):
    enc = encoder(tokenizer)
    pid = TaskContext.get().partitionId()
    packers: dict[str, _Packer] = {}
    rows: list[tuple] = []

    def flush():
        columns = list(zip(*rows))
        arrays = [pa.array([pid] * len(rows), pa.int32()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.list_(_SEGMENT))]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, ["pid", "source", "at", "n_tokens", "tokens", "segments"])

    def close(source: str, packer: _Packer):
        at, used, tokens, segments = packer.close()
        rows.append((source, at, used, None if with_text else tokens, segments))

    for batch in batches:
        for doc_id, text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source"))):
            if not text:
                continue
            ids = enc.encode(text)
            packer = packers.setdefault(source, _Packer(block_tokens, enc.eot, enc.dtype))
            cuts = [0]
            while cuts[-1] < len(ids):
                cuts.append(min(len(ids), cuts[-1] + block_tokens - (packer.used if len(cuts) == 1 else 0)))
            texts = _cuts(text.encode("utf-8", "replace"), enc.byte_lengths(ids), cuts) if with_text else [None] * (len(cuts) - 1)
            for a, b, piece in zip(cuts, cuts[1:], texts):
                packer.parts.append(ids[a:b])
                packer.segments.append({"doc_id": doc_id, "start": a, "n_tokens": b - a, "lang": lang, "text": piece})
                packer.used += b - a
                if packer.used == block_tokens:
                    close(source, packer)
            if packer.used:  # the end of a document that fills its block exactly is the block's
                packer.parts.append(packer.end)
                packer.used += 1
                if packer.used == block_tokens:
                    close(source, packer)
            if len(rows) >= 256:
                yield flush()
    for source, packer in packers.items():
        if packer.used:
            close(source, packer)
    if rows:
        yield flush()


def pack_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """Blocks of ``block_tokens`` ids of one source each, as a written table: (pid, source, at)
    names a block; ``segments`` are the documents' parts in it, with their texts if asked for
    (and then without ``tokens``).

    Documents follow each other as the input's files have them, with an end-of-text id after
    each.  The last, partial blocks that a source has in the input splits are joined as long as
    they fit into one, and padded with that id; ``n_tokens`` doesn't count the padding.  Null and
    empty texts give nothing.  A null source counts as "".  Long texts run over many blocks.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source").withColumn("source", F.coalesce("source", F.lit("")))
    packed = written(rows.mapInArrow(partial(_pack, block_tokens, tokenizer, with_text), _BLOCKS), "mix-blocks")
    tails = packed.where(F.col("n_tokens") < block_tokens)
    bins = tails.select("source", "pid", "at", "n_tokens", F.expr(f"pid div {_TAILS}").cast("int").alias("grp")).groupBy("source", "grp").applyInPandas(lambda own: _binned(block_tokens, own), "source string, pid int, at long, grp int, bin long")
    joined = tails.join(bins, ["source", "pid", "at"]).groupBy("source", "grp", "bin").agg(F.sort_array(F.collect_list(F.struct("pid", "n_tokens", "tokens", "segments"))).alias("parts"))
    joined = joined.select((-F.col("grp") - 1).alias("pid"), "source", F.col("bin").alias("at"), F.aggregate("parts", F.lit(0), lambda n, p: n + p["n_tokens"]).alias("n_tokens"), F.transform("parts", lambda p: p["tokens"]).alias("tokens"), F.transform("parts", lambda p: p["n_tokens"]).alias("used"), F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"))
    joined = written(joined.mapInArrow(partial(_padded, block_tokens, tokenizer), _BLOCKS), "mix-tails")
    return packed.where(F.col("n_tokens") == block_tokens).unionByName(joined)


def _binned(block_tokens: int, tails: pd.DataFrame) -> pd.DataFrame:
    """Which block each of a source's partial blocks goes to: in order, a new one when the next doesn't fit."""
    tails = tails.sort_values(["pid", "at"])
    number, used, bins = 0, 0, []
    for n in tails["n_tokens"]:
        if used + n > block_tokens:
            number, used = number + 1, 0
        used += n
        bins.append(number)
    return tails[["source", "pid", "at", "grp"]].assign(bin=bins)


def _padded(block_tokens: int, tokenizer: str, batches):
    enc = encoder(tokenizer)
    for batch in batches:
        tokens = []
        for parts, used in zip(batch.column("tokens").to_pylist(), batch.column("used").to_pylist()):
            if parts[0] is None:
                tokens.append(None)
                continue
            ids = [np.frombuffer(p, enc.dtype)[:n] for p, n in zip(parts, used)]
            tokens.append(np.concatenate([*ids, np.full(block_tokens - sum(used), enc.eot, enc.dtype)]).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pid", "source", "at", "n_tokens")), pa.array(tokens, pa.binary()), batch.column("segments")], ["pid", "source", "at", "n_tokens", "tokens", "segments"])


def permuted(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each ``key``, applied to ``index``: a Feistel
    network over the next power of four, walked until it falls below n."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _draws(group: int, n_slots: int, shard_slots: int, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of a group, their slots, and the drawn counts (shards x sources)."""
    n_shards = -(-n_slots // shard_slots)
    shards = np.arange(group * _GROUP, min((group + 1) * _GROUP, n_shards))
    slots = np.minimum(shard_slots, n_slots - shards * shard_slots)
    counts = np.stack([np.random.default_rng([seed, int(s)]).multinomial(k, weights) for s, k in zip(shards, slots)])
    return shards, slots, counts


def draw_slots(spark, sources: list[str], n_blocks: list[int], weights: list[float], n_slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, epoch, block) of every output slot; ``block`` is an index below the
    source's number of blocks."""
    p = np.asarray(weights, dtype=float) / sum(weights)
    sizes = np.asarray(n_blocks, dtype=np.int64)
    n_groups = -(-n_slots // (shard_slots * _GROUP))

    def totals(batches):
        for pdf in batches:
            for g in pdf["id"]:
                count = _draws(g, n_slots, shard_slots, p, seed)[2].sum(axis=0)
                yield pd.DataFrame({"grp": g, "s": np.arange(len(p)), "n": count})

    before = Window.partitionBy("s").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    first = spark.range(0, n_groups, 1, max(1, min(n_groups, spark.sparkContext.defaultParallelism * 4))).mapInPandas(totals, "grp long, s int, n long")
    first = first.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("s", "first"))).alias("f"))

    def slots(batches):
        for pdf in batches:
            for g, firsts in zip(pdf["grp"], pdf["firsts"]):
                shards, _, counts = _draws(g, n_slots, shard_slots, p, seed)
                ordinal = np.asarray(firsts, dtype=np.int64).copy()
                for shard, count in zip(shards, counts):
                    s = np.repeat(np.arange(len(p)), count)
                    k = ordinal[s] + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
                    ordinal += count
                    epoch, index = k // sizes[s], k % sizes[s]
                    block = np.empty(len(s), dtype=np.int64)
                    for j in np.flatnonzero(count):
                        own = s == j
                        key = (epoch[own] * len(p) + j).astype(np.uint64) + np.uint64(seed * 0x1000193 & 0xFFFFFFFFFFFFFFFF)
                        block[own] = permuted(index[own], int(sizes[j]), key)
                    slot = np.random.default_rng([seed, int(shard), 1]).permutation(len(s))
                    yield pd.DataFrame({"shard": shard, "slot": slot.astype(np.int32), "source": np.asarray(sources, dtype=object)[s], "epoch": epoch, "block": block})

    return first.select("grp", F.transform("f", lambda x: x["first"]).alias("firsts")).mapInPandas(slots, "shard long, slot int, source string, epoch long, block long")


def mix_blocks(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, temperature: float = TEMPERATURE, seed: int = SEED, tokenizer: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, tokens, segments): one row for each slot.

    ``weights`` are target shares of tokens by source (missing ones get nothing, those of absent
    sources are ignored); padding doesn't count, so a source whose blocks are less full is drawn
    more often.  By default a weight is a source's tokens to the power ``temperature``.  There are
    ``epochs`` times as many slots as blocks.  A source that is drawn more often than it has
    blocks starts again in another order, so none of its blocks comes twice before all came once.
    Equal rows are drawn as separate ones.  Without any tokens or weight the result is empty, also
    for an empty table.  Null texts and other columns don't matter, long texts run over many blocks.

    Blocks are shuffled once, by their names; all else that moves is narrow.
    """
    blocks = pack_blocks(docs, block_tokens, tokenizer, with_text)
    spark = docs.sparkSession
    by_task = blocks.groupBy("source", "pid").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    if (found := by_task.select("source").distinct().count()) > MAX_SOURCES:
        raise ValueError(f"{found} sources; join rare ones until there are at most {MAX_SOURCES}")
    totals = {r["source"]: (r["n"], r["tokens"]) for r in by_task.groupBy("source").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    share = {s: (weights.get(s, 0.0) if weights is not None else t**temperature) for s, (_, t) in sorted(totals.items())}
    share = {s: w * totals[s][0] / totals[s][1] for s, w in share.items() if w > 0}  # of slots: by the mean tokens of a block
    output = ["shard", "slot", "source", "epoch", "block", "n_tokens", "tokens", "segments"]
    if not share:
        schema = "shard long, slot int, source string, epoch long, block long, " + _BLOCKS.split("at long, ")[1]
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    n_slots = max(1, round(epochs * sum(n for n, _ in totals.values())))
    slots = draw_slots(spark, list(share), [totals[s][0] for s in share], list(share.values()), n_slots, shard_slots, seed)
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "pid", "first", "n", F.explode(F.sequence(F.expr(f"first div {_SPAN}"), F.expr(f"(first + n - 1) div {_SPAN}"))).alias("span"))
    named = slots.withColumn("span", F.expr(f"block div {_SPAN}")).join(ranges.hint("shuffle_hash"), ["source", "span"]).where("block >= first and block < first + n").select("shard", "slot", "source", "epoch", "block", "pid", (F.col("block") - F.col("first")).alias("at"))
    return blocks.join(named.hint("shuffle_hash"), ["source", "pid", "at"]).select(*output)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows of (doc_id, text, lang, source, n_chars): each is the part of a
    document that lies in one drawn block.  Documents are cut where blocks end, sources that
    are drawn more often than once repeat, and blocks that no slot draws are left out."""
    mixed = mix_blocks(docs, with_text=True, **options).select("source", F.explode("segments").alias("s"))
    return mixed.where("s.text <> ''").select("s.doc_id", "s.text", "s.lang", "source", F.length("s.text").cast("long").alias("n_chars"))
