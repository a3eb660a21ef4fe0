"""Token ids on disk: documents compressed one by one with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import new_path, pick, written
from tessella.llm.tokens import TOKENIZER, encoder

DICTIONARY_BYTES = 112_640
#: Each task trains a dictionary of ``LOCAL_BYTES`` on every ``TRAINING_BYTES`` of ids; so many are merged at a time.
LOCAL_BYTES, TRAINING_BYTES, MERGED = 65_536, 16 << 20, 64
_PIECE = 1024  # a dictionary is a sample for the next one in pieces of this size
LEVEL = 3
_INDEX = "doc_id long, shard string, offset long, n_bytes int, n_tokens int, dict_hash string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _encode(tokenizer: str, batches):
    enc = encoder(tokenizer)
    for batch in batches:
        ids = [enc.encode(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _train(size: int, samples: list[bytes]) -> bytes:
    """A dictionary from samples; where these are too few to train on they serve as raw content."""
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _local_dictionaries(batches):
    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def train():
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([_train(LOCAL_BYTES, held)], pa.binary())], ["part", "at", "dictionary"])

    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            # a text of any length is trained on in pieces, so that no task holds more than about ``TRAINING_BYTES``
            for piece in (raw[i : i + TRAINING_BYTES] for i in range(0, len(raw), TRAINING_BYTES)):
                held.append(piece)
                size += len(piece)
                if size >= TRAINING_BYTES:
                    yield train()
                    n, held, size = n + 1, [], 0
    if held:
        yield train()


def _merged(size: int, dictionaries: list[bytes]) -> bytes:
    if len(dictionaries) == 1:
        return dictionaries[0]
    return _train(size, [d[i : i + _PIECE] for d in dictionaries for i in range(0, len(d), _PIECE)])


def train_dictionary(encoded: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on the serialised ids of all documents in the written table
    ``encoded`` (doc_id, ids): tasks train on what they read, and their dictionaries are the
    samples of the next ones until one is left.  A table without ids gives b""."""
    local = encoded.select("ids").mapInArrow(_local_dictionaries, "part long, at long, dictionary binary")
    local = written(local.where("dictionary <> ''"), "token-dictionaries")
    while local.count() > MERGED:
        order = Window.partitionBy("of").orderBy("part", "at")
        grouped = local.withColumn("of", F.pmod(F.xxhash64("part", "at"), F.lit(1 + local.count() // MERGED))).withColumn("k", F.row_number().over(order))
        grouped = grouped.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "dictionary"))), lambda x: x["dictionary"]).alias("all"))

        def merge(batches):
            for batch in batches:
                merged = [_merged(LOCAL_BYTES, d) for d in batch.column("all").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array([0] * len(merged), pa.int64()), pa.array(merged, pa.binary())], ["part", "at", "dictionary"])

        local = written(grouped.mapInArrow(merge, "part long, at long, dictionary binary"), "token-dictionaries")
    return _merged(size, [bytes(r["dictionary"]) for r in local.orderBy("part", "at").collect()])  # at most ``MERGED``


def _write(path: str, dictionary: bytes, width: int, level: int, batches):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared is not None:
        shared.precompute_compress(level=level)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False).compress
    digest = hashlib.sha256(dictionary).hexdigest()
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"  # a lost attempt's file is in no index
    system, root = _filesystem(path)
    with system.open_output_stream(f"{root}/{name}") as out:
        offset = 0
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, raw in zip(ids, batch.column("ids").to_pylist()):
                frame = squeeze(raw)
                out.write(frame)
                rows.append((doc_id, name, offset, len(frame), len(raw) // width, digest))
                offset += len(frame)
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "shard", "offset", "n_bytes", "n_tokens", "dict_hash"])


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Write a store and return its index: (doc_id, shard, offset, n_bytes, n_tokens, dict_hash).

    ``path`` (by default a new one in the shared folder) gets the frames in ``part-*.bin``, the
    ``dictionary``, the type of the ids in ``dtype`` and the ``index``.  Each document is a
    zstandard frame of its own, so reading one takes one range read.  Each row has its own frame,
    repeated ones and repeated doc_ids too; null and empty texts have a frame of no ids.  Very
    long texts are one frame like others.  Other columns don't matter.  An empty table gives an
    empty index.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    encoded = written(pick(docs, "doc_id", "text").mapInArrow(partial(_encode, tokenizer), "doc_id long, ids binary"), "token-ids")
    dictionary, dtype = train_dictionary(encoded, dictionary_bytes), encoder(tokenizer).dtype
    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)
    for name, content in (("dictionary", dictionary), ("dtype", dtype.str.encode())):
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(content)
    encoded.mapInArrow(partial(_write, path, dictionary, dtype.itemsize, level), _INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


class TokenStore:
    """Reads documents of a store; each read is of one frame."""

    def __init__(self, path: str):
        import zstandard

        self._system, self._root = _filesystem(path)
        with self._system.open_input_stream(f"{self._root}/dictionary") as f:
            raw = f.read()
        with self._system.open_input_stream(f"{self._root}/dtype") as f:
            self._dtype = np.dtype(f.read().decode())
        self.dict_hash = hashlib.sha256(raw).hexdigest()
        self._decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None).decompress

    def read(self, shard: str, offset: int, n_bytes: int, dict_hash: str) -> np.ndarray:
        """The ids at an index row's place; a row of another dictionary is an error."""
        if dict_hash != self.dict_hash:
            raise ValueError("the frame was written with another dictionary")
        with self._system.open_input_file(f"{self._root}/{shard}") as f:
            return np.frombuffer(self._decompress(f.read_at(n_bytes, offset)), self._dtype)


def read_tokens(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens) of the rows of ``index``, any part of a store's index, read in order of place."""

    def fetch(batches):
        store = TokenStore(path)
        for batch in batches:
            tokens = [store.read(*r).tobytes() for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_bytes", "dict_hash")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    return index.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(fetch, "doc_id long, tokens binary")
