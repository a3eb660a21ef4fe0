"""Interpolated modified Kneser-Ney language model, counted in Spark.

Words are numbered first, frequent ones low, so that an n-gram is a few small integers.  Tasks
count their n-grams in numpy and send sorted, compressed runs to buckets by context; each bucket
merges its runs in a stream, writes its arrays to the shared folder and passes on its distinct
n-grams, without their first words, as the continuation counts of the next lower order.  Workers
map the arrays into memory and look up the distinct n-grams of some MB of texts at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_path, pick
from tessella.llm.words import CHUNK_BYTES, mix, word_batches

ORDER = 3
_U = np.uint64
#: The numbers of a text's start and end; words have those that follow.
_BOS, _EOS = 0, 1
_EMPTY = _U(0x243F6A8885A308D3)
#: N-grams that a task gathers before it counts and sends them, and rows that a bucket's merge holds before it joins them.
_BUFFER = 2_000_000
#: Texts are looked up in runs of so many bytes.
_CHUNK = 4 * CHUNK_BYTES - 64
#: Bytes of text for each bucket of n-grams and of words: what a merge of one holds in memory.
BUCKET_BYTES, WORD_BUCKET_BYTES = 16 << 20, 128 << 20
_RUNS = "bucket int, n long, run binary"
_STATS = ["n1", "n2", "n3", "n4", "total", "t1", "t2", "t3", "kinds"]
#: Contexts that share a full offset; the others' are kept as distances from it.
_BLOCK = 64
#: Keys that share a cell of ``_sorted_keys``, about.
_CELL = 16


def _local(path: str) -> str:
    """The mounted path of the shared folder; mapping into memory needs one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("spark.checkpoint.dir must be a mounted folder for memory-mapped arrays")
    return path


def _columns(ids: np.ndarray, counts: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns (the order-1 words before, then the word itself) of all positions of a run of
    texts, the end of each text included, and the positions per text."""
    texts = np.flatnonzero(counts > 0)
    sizes = counts[texts] + order  # order-1 starts and an end for each text that has a word
    seq = np.full(int(sizes.sum()), _BOS, dtype=_U)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), counts[texts])
    first = np.cumsum(counts[texts]) - counts[texts]
    seq[(ends - sizes)[owner] + order - 1 + np.arange(len(ids)) - first[owner]] = ids
    seq[ends - 1] = _EOS
    predicted = np.ones(len(seq), dtype=bool)
    for j in range(order - 1):
        predicted[ends - sizes + j] = False
    at = np.flatnonzero(predicted)
    places = np.zeros(len(counts), dtype=np.int64)
    places[texts] = counts[texts] + 1
    return [seq[at - j] for j in range(order - 1, -1, -1)], places


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One key for each row, in the order of the rows: columns side by side while they fit into
    64 bits, and ranks of what came before where they don't."""
    key, bits = columns[0], int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        width = int(c.max(initial=0)).bit_length()
        if bits + width > 64:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.zeros(len(key), dtype=_U)
            rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1]).astype(_U)
            key, bits = rank, len(key).bit_length()
        key = (key << _U(width)) | c
        bits += width
    return key


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in order, and the number of each place's key."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _count(columns: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with summed counts.  Rows with counts come as sorted runs, which a
    stable sort merges."""
    key = _joined(columns)
    order = np.argsort(key, kind=None if n is None else "stable")
    key = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    at = order[starts]
    sums = np.diff(np.append(starts, len(order))) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n
    return [c[at] for c in columns], sums.astype(np.int64)


def _key(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, int]:
    """A key for each row of numbers below 2**bits, spread evenly over 64 bits, and how many of
    its upper bits are in use.  Rows of up to 64 bits get a permutation (a Feistel network), so
    different rows have different keys; longer ones get a hash."""
    size = bits * len(columns)
    if size > 64:
        x = np.full(len(columns[0]), _EMPTY, dtype=_U)
        for c in columns:
            x = mix(x + c * _U(0x9E3779B97F4A7C15))
        return x, 64
    x = columns[0]
    for c in columns[1:]:
        x = (x << _U(bits)) | c
    half = max(1, (size + 1) // 2)
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for r in range(4):
        left, right = right, left ^ (mix(right + _U((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask)
    return ((left << _U(half)) | right) << _U(64 - 2 * half), 2 * half


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows in order, as differences from the row before within equal leading columns, by the
    byte planes that are in use; their numbers come first."""
    import zstandard

    parts, same = [], np.ones(max(0, len(n) - 1), dtype=bool)
    for c in columns:
        d = c.copy()
        d[1:] = np.where(same, c[1:] - c[:-1], c[1:])
        same &= c[1:] == c[:-1]
        parts.append(d)
    parts.append(n.astype(_U))
    used = [max(1, -(-int(p.max()).bit_length() // 8)) for p in parts]
    planes = b"".join([bytes(used), *(p.astype("<u8", copy=False).view("u1").reshape(-1, 8)[:, :k].T.tobytes() for p, k in zip(parts, used))])
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpacked(runs: Iterator[tuple[int, bytes]], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of all runs (number of rows, packed)."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    parts: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
    for n, run in runs:
        raw = np.frombuffer(expand(run), "u1")
        used, at, rows = raw[: width + 1].tolist(), width + 1, []
        for k in used:
            wide = np.zeros((n, 8), "u1")
            wide[:, :k] = raw[at : at + k * n].reshape(k, n).T
            rows.append(wide.view("<u8").ravel())
            at += k * n
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for c in range(width):
            starts = np.flatnonzero(new)
            sums = np.cumsum(rows[c])
            column = sums - np.repeat(sums[starts] - rows[c][starts], np.diff(np.append(starts, n)))
            new[1:] |= column[1:] != column[:-1]
            parts[c].append(column)
        parts[width].append(rows[width])
    *columns, counts = [np.concatenate(p) for p in parts]
    return columns, counts.astype(np.int64)


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of a bucket's runs in order, with summed counts.  Runs are joined
    whenever about as many rows came as are held, so memory is in proportion to distinct rows."""
    held: tuple[list[np.ndarray], np.ndarray] | None = None
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def join():
        nonlocal held, size
        columns, n = _unpacked(waiting, width)
        if held is not None:
            columns, n = [np.concatenate(c) for c in zip(held[0], columns)], np.concatenate([held[1], n])
        held, size = _count(columns, n), 0
        waiting.clear()

    for batch in batches:
        for n, run in zip(batch.column("n").to_pylist(), batch.column("run").to_pylist()):
            waiting.append((n, run))
            size += n
            if size >= max(_BUFFER, 0 if held is None else len(held[1])):
                join()
    if waiting:
        join()
    return held


def _run_batch(columns: list[np.ndarray], n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A run for each bucket, from rows in order."""
    order = np.argsort(_narrow(bucket), kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        at = order[a:b]
        rows.append((int(ordered[a]), b - a, _packed([c[at] for c in columns], n[at])))
    b, n, run = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(run, pa.binary())], ["bucket", "n", "run"])


def _gram_run(columns: list[np.ndarray], n: np.ndarray, bits: int, buckets: int) -> pa.RecordBatch:
    """Runs of n-grams in order, to buckets by their contexts."""
    context = columns[: max(1, len(columns) - 1)]
    starts = _starts(context)
    bucket = _bucket(_key([c[starts] for c in context], bits)[0], buckets)
    return _run_batch(columns, n, np.repeat(bucket, np.diff(np.append(starts, len(n)))))


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows in order differ from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Unsigned arrays as one file, so that one mapping serves them.  Write and rename: a task
    that runs again leaves the same file."""
    temporary = f"{folder}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(temporary, "wb") as out:
        np.array([len(arrays), *(v for a in arrays for v in (a.itemsize, len(a)))], dtype="<u8").tofile(out)
        for a in arrays:
            a.tofile(out)
            out.write(bytes(-a.nbytes % 8))
    os.replace(temporary, f"{folder}/{name}")


@lru_cache(maxsize=1 << 14)
def _load(path: str) -> list[np.ndarray] | None:
    """The arrays of ``_save``, mapped; none where a bucket has no rows."""
    if not os.path.exists(path):
        return None
    raw = np.asarray(np.memmap(path, "u1", "r"))
    m = int(raw[:8].view("<u8")[0])
    sizes = raw[8 : 8 + 16 * m].view("<u8").astype(int).reshape(-1, 2)
    at, out = 8 + 16 * m, []
    for item, n in sizes:
        out.append(raw[at : at + item * n].view(f"<u{item}"))
        at += item * n + -(item * n) % 8
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else "u1")


def _first_not_below(array: np.ndarray, low: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places in [low, low + size), where ``array`` is in order, that aren't below the
    targets, and whether they hold them."""
    place, end = low.copy(), low + size
    step = 1 << max(0, int(size.max(initial=0)).bit_length() - 1)
    while step and len(place):
        at = np.flatnonzero(size >= step) if step > 1 else slice(None)
        here, last = place[at], end[at]
        probe = np.minimum(here + step, last) - 1
        below = (array[np.maximum(probe, 0)] < target[at]) & (here + step <= last)
        here += below * step
        place[at] = here
        step >>= 1
    hit = place < end
    hit[hit] = array[place[hit]] == target[hit]
    return place, hit


def _sorted_keys(keys: np.ndarray, used: int) -> list[np.ndarray]:
    """Keys in order as [(first cell, bits of a cell), where each cell begins, lower bits].  Cells
    have about ``_CELL`` keys, and at most 32 bits are kept of each key; where so many cells would
    outweigh that, [none, none, keys]."""
    values = keys >> _U(64 - used)
    span = int(values[-1] - values[0]) + 1
    shift = min(32, max(0, (span * _CELL // len(keys)).bit_length() - 1))
    above = values >> _U(shift)
    cells = int(above[-1] - above[0]) + 1
    if cells > max(1, len(keys) // 4):
        return [np.zeros(0, "<u8"), np.zeros(0, "<u8"), keys]
    offsets = np.searchsorted(above - above[0], np.arange(cells + 1).astype(_U))
    kind = "u1" if shift <= 8 else "<u2" if shift <= 16 else "<u4"
    return [np.array([above[0], shift], "<u8"), _narrow(offsets), (values & _U((1 << shift) - 1)).astype(kind)]


def _find(head: np.ndarray, cells: np.ndarray, held: np.ndarray, keys: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in order among those of ``_sorted_keys``, and whether they are there."""
    if not len(head):
        place = np.searchsorted(held, keys)
        hit = place < len(held)
        hit[hit] = held[place[hit]] == keys[hit]
        return place, hit
    values = keys >> _U(64 - used)
    cell = (values >> head[1]).astype(np.int64) - int(head[0])
    inside = (cell >= 0) & (cell < len(cells) - 1)
    cell[~inside] = 0
    low = cells[cell].astype(np.int64)
    size = np.where(inside, cells[cell + 1] - low, 0)
    return _first_not_below(held, low, size, (values & ((_U(1) << head[1]) - _U(1))).astype(held.dtype))


def _small_counts(n: np.ndarray) -> list[np.ndarray]:
    """Counts as a byte each; 255 stands for one from the list of places and counts."""
    large = np.flatnonzero(n >= 255)
    return [np.minimum(n, 255).astype("u1"), large.astype("<u8"), n[large].astype("<u8")]


def _counts(small: np.ndarray, at: np.ndarray, large: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = small[places].astype(np.int64)
    more = out == 255
    out[more] = large[np.searchsorted(at, places[more].astype(_U))]
    return out


def _count_words(buckets: int, batches):
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def send():
        words, n = _count([np.concatenate(held)], np.concatenate(counts))
        return _run_batch(words, n, _bucket(words[0], buckets))

    for batch in batches:
        for _, words, _ in word_batches(batch.column("text").to_pylist(), _CHUNK):
            distinct, n = np.unique(words, return_counts=True)
            held.append(distinct)
            counts.append(n)
            size += len(distinct)
            if size >= _BUFFER:
                yield send()
                held, counts, size = [], [], 0
    if size:
        yield send()


def _merge_words(folder: str):
    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write a bucket's words, the magnitude of each one's count and its rank within it."""
        (words,), n = _merged(batches, 1)
        magnitude = np.frexp(n.astype(float))[1]
        order = np.argsort(magnitude, kind="stable")
        sizes = np.bincount(magnitude, minlength=64)
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _save(folder, f"words-{key[0].as_py()}", [words, magnitude.astype("u1"), _narrow(rank)])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["bucket", "sizes"])

    return merge


class Words:
    """The numbers of all words: by magnitude of their counts, then by bucket."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.buckets = folder, len(sizes)
        flat = sizes[:, ::-1].T.ravel()  # magnitudes downwards, buckets upwards
        first = (np.cumsum(flat) - flat + 2).reshape(sizes.shape[1], -1)[::-1]
        _save(folder, "words", [np.ascontiguousarray(first).ravel().astype("<u8")])
        self.unknown = int(flat.sum()) + 2
        self.bits = self.unknown.bit_length()

    def ids(self, distinct: np.ndarray) -> np.ndarray:
        """The numbers of hashed words in order."""
        out = np.full(len(distinct), self.unknown, dtype=_U)
        first = _load(f"{self.folder}/words")[0].reshape(-1, self.buckets)
        bounds = np.searchsorted(_bucket(distinct, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            if (part := _load(f"{self.folder}/words-{b}")) is None:
                continue
            held, magnitude, rank = part
            own = distinct[bounds[b] : bounds[b + 1]]
            place = np.searchsorted(held, own)
            hit = place < len(held)
            hit[hit] = held[place[hit]] == own[hit]
            place = place[hit]
            out[bounds[b] + np.flatnonzero(hit)] = first[magnitude[place], b] + rank[place].astype(_U)
        return out


def _numbered(words: Words, hashed: np.ndarray) -> np.ndarray:
    at, number = _groups(hashed)
    return words.ids(hashed[at])[number]


def _gather(order: int, words: Words, buckets: int, batches):
    held: list[list[np.ndarray]] = []
    size = 0

    def send():
        columns, n = _count([np.concatenate(c) for c in zip(*held)], None)
        return _gram_run(columns, n, words.bits, buckets)

    for batch in batches:
        for _, hashed, counts in word_batches(batch.column("text").to_pylist(), _CHUNK):
            columns, _ = _columns(_numbered(words, hashed), counts, order)
            held.append(columns)
            size += len(columns[0])
            if size >= _BUFFER:
                yield send()
                held, size = [], 0
    if size:
        yield send()


def _merge(folder: str, level: int, bits: int, buckets: int, bucket: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a bucket: write its arrays and return the next lower order's runs."""
    columns, n = _merged(batches, level)
    if level > 1:
        yield _gram_run(*_count(columns[1:], None), bits, buckets)
    context = columns[: max(1, level - 1)]
    starts = _starts(context)
    x, used = _key([c[starts] for c in context], bits)
    by = np.argsort(x)
    sizes = np.diff(np.append(starts, len(n)))[by]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    order = np.arange(len(n)) + np.repeat(starts[by] - offsets[:-1], sizes)  # contexts by key, their words as they are
    x, word, n = x[by], columns[-1][order], n[order]
    stats = np.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), n.sum(), (n == 1).sum(), (n == 2).sum(), (n > 2).sum(), len(n)], dtype="<u8")
    if level == 1:
        arrays = [stats, *_sorted_keys(x, used), *_small_counts(n)]
    else:
        sums = [np.add.reduceat(v.astype(np.int64), offsets[:-1]).astype(_U) for v in (n, n == 1, n == 2, n > 2)]
        # contexts share few different sums: each row is kept once
        at, which = _groups(_joined(sums))
        base = offsets[::_BLOCK]
        arrays = [stats, *_sorted_keys(x, used), base.astype("<u8"), _narrow(offsets - np.repeat(base, _BLOCK)[: len(offsets)]), _narrow(which), np.stack([s[at] for s in sums], axis=1).ravel().astype("<u8"), _narrow(word), *_small_counts(n)]
    _save(folder, f"{level}-{bucket}", arrays)


def _merger(folder: str, level: int, bits: int, buckets: int):
    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(folder, level, bits, buckets, key[0].as_py(), batches)

    return merge


def _discounts(s) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; plain halves where they are too few."""
    n1, n2, n3, n4 = (s[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d))


class Model:
    """A trained model: where its arrays lie, its words, and a few numbers for each order."""

    def __init__(self, folder: str, order: int, words: Words, buckets: int, stats: list[dict]):
        self.folder, self.order, self.words, self.buckets, self.stats = folder, order, words, buckets, stats

    def log_probabilities(self, hashed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities of all words and ends of a run of texts, and their number per
        text.  Each level's distinct n-grams are numbered, looked up and scored once; an n-gram is
        the number of the one that ends a place before and a word."""
        at, number = _groups(hashed)
        names = np.concatenate([np.array([_BOS, _EOS], dtype=_U), self.words.ids(hashed[at])])
        columns, places = _columns(number.astype(_U) + _U(2), counts, self.order)
        word = columns[-1]
        if not len(word):
            return np.zeros(0), places
        first = np.zeros(len(word), dtype=bool)
        ends = np.cumsum(places[places > 0])
        first[np.concatenate([[0], ends[:-1]])] = True
        number, p = word.astype(np.int64), None
        for k in range(1, self.order + 1):
            s, d = self.stats[k - 1], np.array([0.0, *_discounts(self.stats[k - 1])])
            if k == 1:
                n, _ = self._look(1, [names], np.zeros(0, dtype=np.int64), names)
                rest = d[1] * s["t1"] + d[2] * s["t2"] + d[3] * s["t3"]
                p = (n - d[np.minimum(n, 3)]) / s["total"] + rest / s["total"] / (s["kinds"] + 1)
                continue
            lower, before = number, np.empty_like(number)  # the context ends a place before
            before[1:] = number[:-1]
            before[first] = len(p)  # starts only
            at = np.full(len(p) + 1, -1)
            at[before] = np.arange(len(before))
            kinds = np.flatnonzero(at >= 0)
            context = [names[c[at[kinds]].astype(np.int64)] for c in columns[self.order - k : -1]]
            by = np.argsort(_key(context, self.words.bits)[0])
            rank = np.empty(len(p) + 1, dtype=np.int64)
            rank[kinds[by]] = np.arange(len(by))
            at, number = _groups(rank[before].astype(_U) << _U(32) | word)
            owner = rank[before[at]]
            n, sums = self._look(k, [c[by] for c in context], owner, names[word[at].astype(np.int64)])
            seen = sums[:, 0] > 0
            total = np.where(seen, sums[:, 0], 1.0)
            back = np.where(seen, (sums[:, 1] * d[1] + sums[:, 2] * d[2] + sums[:, 3] * d[3]) / total, 1.0)
            p = (n - d[np.minimum(n, 3)]) / total[owner] + back[owner] * p[lower[at]]
        return np.log(p)[number], places

    def _look(self, level: int, context: list[np.ndarray], owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ``word`` after the contexts that ``owner`` names, and the contexts' sums.
        Contexts come in the order of their keys, words in that of their owners; at level 1 the
        words themselves are looked up."""
        x, used = _key(context, self.words.bits)
        sums = np.zeros((len(x), 4))
        by = None
        if level == 1:
            by = np.argsort(x)
            x = x[by]
        n = np.zeros(len(word), dtype=np.int64)
        bounds = np.searchsorted(_bucket(x, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            if (part := _load(f"{self.folder}/{level}-{b}")) is None:
                continue
            place, hit = _find(*part[1:4], x[bounds[b] : bounds[b + 1]], used)
            own = bounds[b] + np.flatnonzero(hit)
            place = place[hit]
            if level == 1:
                n[by[own]] = _counts(*part[4:], place)
                continue
            base, distance, which, kinds, words, *counts = part[4:]
            sums[own] = kinds.reshape(-1, 4)[which[place]]
            low, high = (base[i // _BLOCK].astype(np.int64) + distance[i] for i in (place, place + 1))
            begin, end = np.searchsorted(owner, [bounds[b], bounds[b + 1]])
            slot = np.full(bounds[b + 1] - bounds[b], -1)
            slot[own - bounds[b]] = np.arange(len(own))
            slot = slot[owner[begin:end] - bounds[b]]
            to = begin + np.flatnonzero(slot >= 0)
            slot = slot[slot >= 0]
            # numbers beyond the bucket's greatest aren't there, and wouldn't fit its type
            target = word[to]
            found, there = _first_not_below(words, low[slot], (high - low)[slot], np.minimum(target, np.iinfo(words.dtype).max).astype(words.dtype))
            there[there] = words[found[there]] == target[there]
            n[to[there]] = _counts(*counts, found[there])
        return n, sums


def _stats(folder: str, order: int, batches):
    for batch in batches:
        rows = [(level, *part[0].tolist()) for b in batch.column("id").to_pylist() for level in range(1, order + 1) if (part := _load(f"{folder}/{level}-{b}")) is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["level", *_STATS])


def train(docs: DataFrame, order: int = ORDER, buckets: int | None = None) -> Model:
    """Count all documents.  The number of ``buckets`` follows the bytes of text, one for each
    ``BUCKET_BYTES``; every array is one bucket's."""
    spark = docs.sparkSession
    folder = _local(new_path(spark, "ngrams"))
    os.makedirs(folder, exist_ok=True)
    texts = pick(docs, "text").where("text <> ''")
    size = 0 if buckets else texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, word_buckets = buckets or 1 + size // BUCKET_BYTES, buckets or 1 + size // WORD_BUCKET_BYTES
    sizes = np.zeros((word_buckets, 64), dtype=np.int64)
    for r in texts.mapInArrow(partial(_count_words, word_buckets), _RUNS).groupBy("bucket").applyInArrow(_merge_words(folder), "bucket int, sizes array<long>").collect():
        sizes[r["bucket"]] = r["sizes"]
    words = Words(folder, sizes)
    runs = texts.mapInArrow(partial(_gather, order, words, buckets), _RUNS)
    for level in range(order, 0, -1):
        runs = runs.groupBy("bucket").applyInArrow(_merger(folder, level, words.bits, buckets), _RUNS)
    runs.write.format("noop").mode("overwrite").save()
    parts = spark.range(0, buckets, 1, -(-buckets // 256)).mapInArrow(partial(_stats, folder, order), ", ".join(f"{c} long" for c in ["level", *_STATS]))
    stats = [dict.fromkeys(_STATS, 0) for _ in range(order)]
    for r in parts.groupBy("level").agg(*[F.sum(c).alias(c) for c in _STATS]).collect():
        stats[r["level"] - 1] = {c: r[c] for c in _STATS}
    return Model(folder, order, words, buckets, stats)


def _score(model: Model, batches):
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
        for first, words, counts in word_batches(texts, _CHUNK):
            log_p, places = model.log_probabilities(words, counts)
            owner = np.repeat(np.arange(len(places)), places)
            total = np.bincount(owner, log_p, len(places))
            with np.errstate(divide="ignore", invalid="ignore"):
                perplexity = np.exp(-total / places)
            none = places == 0
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(places)), pa.array(places), pa.array(total, mask=none), pa.array(perplexity, mask=none)], ["doc_id", "n_tokens", "log_prob", "perplexity"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of each row under ``model``.

    Tokens are the words and the end of the text.  A text without words, a null one too, has 0
    tokens and null scores.  Words that were not counted share the mass of the uniform
    distribution.  Repeated rows get equal scores; an empty table gives none.
    """
    return pick(docs, "doc_id", "text").mapInArrow(partial(_score, model), "doc_id long, n_tokens long, log_prob double, perplexity double")


def perplexities(docs: DataFrame, order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """``score`` of all documents by a model that counts all of them (see there for the results)."""
    return score(docs, train(docs, order, buckets))
