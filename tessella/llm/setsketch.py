"""Near-duplicate documents by SetSketch registers.

A document is the set of its word ``shingle``-grams.  Register i of its sketch is
``floor(1 - log_b(min_i))``, where ``min_i`` is the least of exponentially distributed hashes of
the shingles: the minima are kept on an exponential scale and truncated to 16 bits.  Registers of
a union are the maxima of the registers, so sketches merge, and two documents agree in a register
about as often as their sets overlap.

Bands of registers give candidates; the Jaccard similarity of a candidate pair is estimated from
the numbers of registers that are greater, less and equal and from both set sizes by maximum
likelihood, and pairs that may reach the threshold are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import KeyFilter, SharedBits, packed, sized, unpacked, written
from tessella.llm.components import connected_components
from tessella.llm.words import mix, shingle_hashes, word_batches

SHINGLE = 3
THRESHOLD = 0.6
REGISTERS, BAND_ROWS = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: An estimate so far below the threshold, more than two standard errors, still goes to verification.
MARGIN = 0.1
_STEP = 4096
#: Nodes that a block of a bucket has, about; pairs are compared within pairs of blocks.
BLOCK_NODES = 256
#: Rows of blocks that a task compares, about; each meets a few hundred others.
TASK_NODES = 8192
_rng = np.random.default_rng(20_231)
_A = _rng.integers(0, 1 << 63, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=REGISTERS, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of hashed shingles (repeats don't matter)."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), _STEP):
        hashed = np.multiply.outer(_A, shingles[i : i + _STEP])
        hashed += _B[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    minimum = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of the sketches in the rows of ``x`` and ``y``."""
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - above - below
    u = nx / (nx + ny)
    v = 1 - u

    def share(z):
        return -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        p, q = share(u - v * j), share(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(n > 0, n * np.log(np.maximum(w, 1e-300)), 0.0) for n, w in ((above, p), (below, q), (equal, 1 - p - q))]
        return parts[0] + parts[1] + parts[2]

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(32):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = score(a) > score(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _texts_by_set(shingle: int):
    """Map (uid, text) batches to per-document sorted shingle sets."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for first, hashes, counts in word_batches(batch.column("text").to_pylist()):
            shingles, sizes = shingle_hashes(hashes, counts, shingle)
            ends = np.cumsum(sizes)
            for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                if size:
                    yield first + i, np.unique(shingles[end - size : end])

    return sets


def _sketch(shingle: int):
    def sketch(batches):
        sets = _texts_by_set(shingle)
        for batch in batches:
            at, first, second, sizes, sketches = [], [], [], [], []
            for i, s in sets(batch):
                at.append(i)
                first.append(mix(s).sum())
                second.append(mix(s ^ np.uint64(0x5BD1E995)).sum())
                sizes.append(len(s))
                sketches.append(registers(s).tobytes())
            at = pa.array(at, pa.int64())
            keys = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (first, second)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "u1", "u2")), *keys, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], ["doc_id", "u1", "u2", "h1", "h2", "n", "registers"])

    return sketch


def _bands(band_rows: int, among: SharedBits | None):
    """(bucket, node) of each band, only for the buckets in ``among`` if that is given."""

    def bands(batches):
        for batch in batches:
            x = _matrix(batch.column("registers"))
            n = REGISTERS // band_rows
            key = np.zeros((len(x), n), dtype=np.uint64)
            for j in range(band_rows):
                key = mix(key + x[:, j : n * band_rows : band_rows].astype(np.uint64) + np.uint64(j * 65_537 + 1))
            key = mix(key + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).ravel().view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), n)
            if among is not None:
                own = among.has(key)
                key, node = key[own], node[own]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["bucket", "node"])

    return bands


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _estimated(batches):
    for batch in batches:
        if batch.num_rows:
            est = estimate(_matrix(batch.column("xa")), _matrix(batch.column("xb")), batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "est"])


def _candidates(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, est) of the distinct ``pairs`` whose estimate reaches ``least``."""
    side = [nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("registers").alias(f"x{k}")) for k in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_estimated, "a long, b long, est double").where(F.col("est") >= least)


def _compared(least: float, threshold: float, batches):
    """(a, b, est) of the pairs within each cell (rows come in the order of ``cell``) that lie in
    different components and may reach the threshold: by their sizes, by their equal registers
    and then by the estimate.  Two rows that are both ``guest`` meet in another cell."""
    held: list[pa.RecordBatch] = []

    def pairs(table: pa.Table):
        x = _matrix(table.column("registers").combine_chunks())
        n, node, root, guest = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "node", "root", "guest"))
        left, right = [], []
        few = (least - MARGIN) * REGISTERS
        for i in range(len(x) - 1):
            may = (root[i + 1 :] != root[i]) & (guest[i + 1 :] + guest[i] < 2) & (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]))
            other = i + 1 + np.flatnonzero(may)
            other = other[(x[other] == x[i]).sum(axis=1) >= few]
            left.append(np.full(len(other), i))
            right.append(other)
        i, j = np.concatenate(left), np.concatenate(right)
        est = np.concatenate([estimate(x[i[k : k + 4096]], x[j[k : k + 4096]], n[i[k : k + 4096]].astype(float), n[j[k : k + 4096]].astype(float)) for k in range(0, max(1, len(i)), 4096)])
        good = est >= least
        i, j = node[i[good]], node[j[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(est[good])], ["a", "b", "est"])

    def groups():
        table = pa.Table.from_batches(held)
        cell = np.stack([table.column(c).to_numpy() for c in ("bucket", "cell")])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        return table, cuts

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table, cuts = groups()
        for a, b in zip([0, *cuts], cuts):
            if b - a > 1:
                yield pairs(table.slice(a, b - a))
        held[:] = table.slice(cuts[-1] if len(cuts) else 0).to_batches()
    if held and (table := groups()[0]).num_rows > 1:
        yield pairs(table)


def _crossed(mixed: DataFrame, nodes: DataFrame, least: float, threshold: float) -> DataFrame:
    """(a, b, est) of the likely pairs of nodes that share a bucket but not a component, from
    ``mixed`` (bucket, node, root).

    Sets whose sizes differ by more than the threshold allows can't be alike, so a bucket is cut
    into ranges of sizes, in which each node meets those of its own and the next range, and ranges
    into blocks by hash.  What is shuffled is a node's row for each pair of blocks that it is in;
    pairs exist only within a task, and only likely ones leave it.
    """
    ranges = mixed.join(nodes.select("node", "n", "registers"), "node").withColumn("range", F.floor(F.log("n") / float(np.log(1 / threshold)) + 1e-9).cast("int"))
    counted = ranges.groupBy("bucket", "range").agg(F.count("*").alias("k"))
    homes = counted.select("bucket", "range", F.col("range").alias("cell"), "k").unionByName(counted.select("bucket", F.col("range"), (F.col("range") - 1).alias("cell"), "k"))
    sizes = homes.groupBy("bucket", "cell").agg(F.sum("k").alias("k"), F.max(F.col("range") == F.col("cell")).alias("own")).where("k > 1 and own").select("bucket", "cell", "k", F.ceil(F.col("k") / BLOCK_NODES).cast("int").alias("blocks"))
    sizes = written(sizes, "near-cells")
    placed = ranges.withColumn("cell", F.explode(F.array("range", F.col("range") - 1))).join(sized(sizes.drop("k")), ["bucket", "cell"])
    placed = placed.withColumn("guest", (F.col("range") != F.col("cell")).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = spread.select("bucket", F.xxhash64("cell", low, high).alias("cell"), "node", "root", "n", "guest", "registers")
    work = sizes.agg(F.sum(F.col("k") * F.col("blocks"))).first()[0] or 0
    ordered = cells.repartition(1 + work // TASK_NODES, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return ordered.mapInArrow(lambda batches: _compared(least, threshold, batches), "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b, est) whose nodes lie in different components, with the roots ra and rb."""
    for side in "ab":
        root = sized(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")))
        pairs = pairs.join(root, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs.where("ra <> rb")


def _set_rows(shingle: int):
    def rows(batches):
        sets = _texts_by_set(shingle)
        for batch in batches:
            found = [(i, (s >> np.uint64(32)).astype("<u4").tobytes()) for i, s in sets(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array([i for i, _ in found], pa.int64())), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"])

    return rows


def _jaccard(batches):
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(p, q))
            out.append(both / (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "jaccard"])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row, u1, u2): each row of ``docs`` with its columns and 128 bits of hashes of
    them; the latter are null where the text is."""
    rows = packed(docs, "doc_id", "text", hashes=("u1", "u2"))
    return rows.withColumns({u: F.when(F.col("text").isNotNull(), F.col(u)) for u in ("u1", "u2")})


class _Groups:
    """The search for groups, over written tables.

    ``members`` is (doc_id, u1, u2, h1, h2) of each row that has a word, with 128 bits of hashes of
    its set; ``nodes`` is (node, h1, h2, u1, u2, n, registers) of each distinct set, with the row
    that its text is read from; ``edges`` (a, b) are verified pairs of nodes, ``roots`` (node, root)
    the components that they make.
    """

    def __init__(self, docs: DataFrame, shingle: int, threshold: float, band_rows: int):
        self.shingle, self.threshold, self.least = shingle, threshold, threshold - MARGIN
        self.rows = _rows(docs).where("text is not null")
        schema = "doc_id long, u1 long, u2 long, h1 long, h2 long, n int, registers binary"
        sketches = written(self.rows.select("doc_id", "u1", "u2", "text").mapInArrow(_sketch(shingle), schema), "near-sketches")
        self.members = sketches.select("doc_id", "u1", "u2", "h1", "h2")
        sets = sketches.groupBy("h1", "h2").agg(F.min(F.struct("u1", "u2")).alias("u"), F.first("n").alias("n"), F.first("registers").alias("registers"))
        self.nodes = written(sets.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "u.*", "n", "registers"), "near-nodes")
        self.edges = self.roots = None
        self.search(band_rows)

    def verify(self, pairs: DataFrame) -> None:
        """Keep those of the written ``pairs`` (a, b) whose shingle sets, from the whole texts,
        reach the threshold, and join what they link."""
        sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
        wanted = written(self.nodes.select("node", "u1", "u2").join(sized(sides.select("node").distinct()), "node", "left_semi"), "near-wanted")
        among = KeyFilter(wanted.select(F.col("u1").alias("key")))  # texts of other rows don't move
        texts = among.keep(self.rows, F.col("u1")).select("u1", "u2", "text").join(sized(wanted), ["u1", "u2"]).select("node", "text")
        sets = texts.mapInArrow(_set_rows(self.shingle), "node long, shingles binary").dropDuplicates(["node"])
        both = sides.join(sets, "node").groupBy("a", "b").agg(F.min_by("shingles", "node").alias("x"), F.max_by("shingles", "node").alias("y"))
        found = written(both.mapInArrow(_jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= self.threshold).select("a", "b"), "near-edges")
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        self.roots = connected_components(self.edges)

    def search(self, band_rows: int) -> None:
        spread = self.nodes.select("node", "registers").mapInArrow(_bands(band_rows, None), "bucket long, node long")
        # any node of a bucket may lead it; the least by bits that differ between buckets
        turned = F.col("node").bitwiseXOR(F.col("bucket"))
        leaders = spread.groupBy("bucket").agg(F.min(turned).alias("least"), F.max(turned).alias("most")).where("least <> most")
        leaders = written(leaders.select("bucket", F.col("least").bitwiseXOR(F.col("bucket")).alias("leader")), "near-leaders")
        among = KeyFilter(leaders.select(F.col("bucket").alias("key"))).shared()
        shared = self.nodes.select("node", "registers").mapInArrow(_bands(band_rows, among), "bucket long, node long")
        collisions = written(shared.join(sized(leaders), "bucket"), "near-buckets")
        sketched = self.nodes.select("node", "n", "registers").join(sized(written(collisions.select("node").distinct(), "near-colliding")), "node", "left_semi")

        led = collisions.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        likely = written(_candidates(led, sketched, self.least), "near-likely")
        best = likely.select("a", "b", "est", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.max_by(F.struct("a", "b"), "est").alias("pair"))
        self.verify(written(best.select("pair.*").distinct(), "near-best"))
        # the other leader pairs, as far as they join different components
        self.verify(written(_apart(likely, self.roots).select("a", "b"), "near-led"))

        # then all pairs of buckets with several components
        rooted = collisions.select("bucket", "node").join(sized(self.roots), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        mixed = rooted.join(sized(written(several, "near-several")), "bucket", "left_semi")
        rest = written(_crossed(written(mixed, "near-mixed"), sketched, self.least, self.threshold), "near-rest")
        # of the pairs between two components the likeliest first: if it holds, the others needn't be read
        between = _apart(rest, self.roots).groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.max_by(F.struct("a", "b"), "est").alias("pair"))
        self.verify(written(between.select("pair.*"), "near-between"))
        self.verify(written(_apart(rest, self.roots).select("a", "b"), "near-left"))

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """Members with their group (g1, g2), and for each group of more than one row its first
        one, by doc_id (nulls last) and then by its hashes: (g1, g2, first, n) with the number of
        rows equal to it."""
        root = self.nodes.select(F.col("node").alias("root"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        moved = self.roots.join(root, "root").join(self.nodes.select("node", "h1", "h2"), "node").select("h1", "h2", "r1", "r2")
        joined = self.members.join(sized(written(moved, "near-moved")), ["h1", "h2"], "left")
        members = written(joined.select("doc_id", "u1", "u2", F.monotonically_increasing_id().alias("at"), F.coalesce("r1", "h1").alias("g1"), F.coalesce("r2", "h2").alias("g2")), "near-members")
        rows = members.groupBy("g1", "g2", "doc_id", "u1", "u2").agg(F.count("*").alias("n"))
        order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "u1", "u2")
        first = rows.groupBy("g1", "g2").agg(F.min(order).alias("first"), F.min_by("n", order).alias("n"), F.sum("n").alias("all")).where("all > 1").drop("all")
        return members, written(first, "near-first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, duplicate_of) for every document but the first, by doc_id (nulls last), of each
    group; a group is a connected component of pairs that reach ``threshold``.

    Equal sets are one node.  In each bucket of a band every node is compared with a leader; each
    node's best estimated partner is verified, then its other leaders if they lie in different
    components.  Then all pairs of each bucket that are still apart are compared as well, in
    blocks, so no candidate is dropped: those skipped are in one component already.  A bucket of
    thousands of copies thus costs comparisons in proportion to its rows.

    Repeated rows are duplicates of each other, of which one is the first.  Null texts and texts
    without a word are in no group; a text of one or two words has one shingle, so only the same
    words make a group.  Very long texts are read whole.  An empty table gives no rows.  Other
    columns don't matter but for rows with equal doc_ids, whose order is by a hash of all columns.
    """
    members, first = _Groups(docs, shingle, threshold, band_rows).grouped()
    found = members.join(sized(first), ["g1", "g2"])
    same = (F.col("u1") == F.col("first.u1")) & (F.col("u2") == F.col("first.u2"))
    # of several equal first rows one is the first
    equal = found.where(same & (F.col("n") > 1))
    one = equal.groupBy("g1", "g2").agg(F.min("at").alias("one"))
    again = equal.join(sized(written(one, "near-equal")), ["g1", "g2"]).where("at <> one")
    return found.where(~same).unionByName(again.drop("one")).select("doc_id", F.col("first.doc_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, band_rows: int = BAND_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the first as in ``near_duplicates``.
    Rows in no group (null texts, no words) all stay.  Extra columns stay as they are.

    Only rows that may be in a group of several, by a bitmap, are joined with the verdicts.
    """
    members, first = _Groups(docs, shingle, threshold, band_rows).grouped()
    same = (F.col("u1") == F.col("first.u1")) & (F.col("u2") == F.col("first.u2"))
    marks = written(members.join(sized(first), ["g1", "g2"]).select("u1", "u2", F.when(same, F.col("n")).otherwise(0).alias("n")).distinct(), "near-marks")
    among = KeyFilter(marks.select(F.col("u1").alias("key")))
    rows = among.mark(_rows(docs).drop("doc_id", "text"), "may", F.col("u1"))
    judged = rows.where("may").join(sized(marks), ["u1", "u2"], "left")
    kept = rows.where("not may").select("row").unionByName(judged.where("n is null or n = 1").select("row"))
    if not marks.where("n > 1").isEmpty():  # one of several equal rows
        kept = kept.unionByName(judged.where("n > 1").groupBy("u1", "u2").agg(F.first("row").alias("row")).select("row"))
    return unpacked(kept, docs)
