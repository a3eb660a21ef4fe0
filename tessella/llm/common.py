"""Shared tables and row keys of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows (of up to a hundred bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a temporary folder is made, but only for a local master: on a
    cluster a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex[:12]}-{name}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the shared tables written so far; only for when no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (a written table of narrow rows) has at most ``limit`` rows."""
    return df.count() <= limit


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted rows allow it; otherwise the join shuffles."""
    return F.broadcast(df) if small(df, limit) else df


#: Bits of a ``KeyFilter`` for each key, and at most (64 MB, twice that as a table): beyond 2**25 keys more others pass by chance.
KEY_BITS, MAP_BITS = 16, 29
_CELL = 15  # bits in a row of the written bitmap, as a power of two
_PIECE = 9  # bits in a row of the broadcast one: each lookup copies a row's bits


class SharedBits:
    """A ``KeyFilter``'s bitmap in Python workers."""

    def __init__(self, power: int, bits):
        self._power, self._bits = power, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(64 - self._power)
        return self._bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


class KeyFilter:
    """A bitmap of the 64-bit hashes (``key``) in a written table, of bounded size whatever their
    number: what isn't in it is certainly none of them, what is may be one."""

    def __init__(self, keys: DataFrame):
        self._power = min(MAP_BITS, (KEY_BITS * max(keys.count(), 1)).bit_length())
        cell, bit = self._place(F.col("key"), _CELL)
        cells = keys.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("map"))
        self._cells = written(cells, "key-bits")  # at most 2**MAP_BITS bits

    def _place(self, key: Column, power: int) -> tuple[Column, Column]:
        """The row of the bitmap, cut into rows of 2**power bits, that has a key's bit, and the
        bit's place in it."""
        bit = F.shiftrightunsigned(key, 64 - self._power)
        return F.shiftright(bit, power), bit.bitwiseAND(F.lit((1 << power) - 1))

    def shared(self) -> SharedBits:
        """The same for Python workers."""
        out = np.zeros((1 << max(0, self._power - _CELL), (1 << _CELL) // 8), dtype=np.uint8)
        for r in self._cells.collect():
            out[r["cell"]] = np.frombuffer(r["map"], dtype=np.uint8)
        return SharedBits(self._power, self._cells.sparkSession.sparkContext.broadcast(out.ravel()))

    def mark(self, rows: DataFrame, name: str, key: Column) -> DataFrame:
        """``rows`` with a column that says whether a key may be one; false for null.  The bitmap
        is broadcast to a join, so no row leaves the JVM or its partition."""
        cell, bit = self._place(key, _PIECE)
        size, pieces = 1 << _PIECE - 3, 1 << _CELL - _PIECE
        cut = self._cells.select("cell", "map", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("i"))
        bits = cut.select((F.col("cell") * pieces + F.col("i")).alias("_cell"), F.col("map").substr(F.col("i") * size + 1, F.lit(size)).alias("_map"))
        placed = rows.withColumns({"_cell": cell, "_bit": bit.cast("int")})
        byte = F.ascii(F.decode(F.col("_map").substr(F.shiftright("_bit", 3) + 1, F.lit(1)), "ISO-8859-1"))
        found = placed.join(F.broadcast(bits.where(F.col("_map") != F.lit(bytes(size)))), "_cell", "left")
        return found.withColumn(name, F.coalesce(F.getbit(byte, F.col("_bit").bitwiseAND(7)) > 0, F.lit(False))).drop("_cell", "_bit", "_map")

    def keep(self, rows: DataFrame, key: Column) -> DataFrame:
        """The ``rows`` whose key may be one."""
        return self.mark(rows, "_may", key).where("_may").drop("_may")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, so that other columns, even ones whose names differ only
    in case, don't matter.  A column that is missing is null."""
    have = docs.columns
    if len({n.lower() for n in have}) == len(have):
        at = {n: n for n in have}
        return docs.select(*[docs[at[n]].alias(n) if n in at else F.lit(None).cast(_types(n)).alias(n) for n in names])
    plain = docs.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"c{have.index(n)}").alias(n) if n in have else F.lit(None).cast(_types(n)).alias(n) for n in names])


def packed(docs: DataFrame, *names: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """The named columns beside ``row``, a struct of all columns (as c0, c1, ...), so that no
    column that an operator adds can clash with one of the input.  ``hashes`` names different
    64-bit hashes of all columns but maps."""
    have = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(have))])
    picked = [F.col(f"c{have.index(n)}").alias(n) if n in have else F.lit(None).cast(_types(n)).alias(n) for n in names]
    known = [F.col(f.name) for f in plain.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = [F.xxhash64(F.lit(i), *known).alias(h) for i, h in enumerate(hashes)]
    return plain.select(*picked, *hashed, F.struct(*[F.col(f"c{i}") for i in range(len(have))]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The input's columns again, from ``row``."""
    out = rows.select(*[F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(len(docs.columns))])
    return out.toDF(*docs.columns)


def _types(name: str) -> str:
    return "long" if name.endswith("_id") or name == "n_chars" else "string"
