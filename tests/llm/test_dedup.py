import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import common, compression, exact, setsketch
from tessella.llm.components import connected_components
from tessella.llm.words import plain, shingle_hashes, word_batches, word_hashes
from tests.llm.cases import SCHEMA, clashing, edited, empty, odd, odd_rows, prose


def test_word_hashes_do_not_depend_on_batches():
    texts = [prose(50, 1), "", None, "One, TWO;three", "é à"]
    together = np.concatenate([h for _, h, _ in word_batches(texts)])
    apart = np.concatenate([word_hashes(t) for t in texts])
    assert (together == apart).all()
    assert (word_hashes("One, TWO;three") == word_hashes("one two THREE")).all()
    assert len(set(word_hashes("a b c ab abc a_b").tolist())) == 6


def test_words_of_other_scripts():
    assert plain("L\u2019été\u00a0«vrai» — fin…").split() == ["l".encode(), "été".encode(), b"vrai", b"fin"]
    assert plain("漢字、かな。ABC").split() == ["漢".encode(), "字".encode(), "か".encode(), "な".encode(), b"abc"]
    assert plain("привет, мир\u3000שלום").split() == ["привет".encode(), "мир".encode(), "שלום".encode()]
    assert len(word_hashes("漢字漢")) == 3 and word_hashes("漢字漢")[0] == word_hashes("漢")[0]


def test_shingles_of_short_texts():
    words, counts = [np.concatenate(x) for x in zip(*[(h, c) for _, h, c in word_batches(["a b", "a b c d", "", "x"])])]
    shingles, sizes = shingle_hashes(words, counts, 3)
    assert sizes.tolist() == [1, 2, 0, 1] and len(set(shingles.tolist())) == 4


@pytest.mark.parametrize("make", [odd, clashing])
def test_exact_rows(spark, make):
    docs = make(spark)
    want = []
    first = {}
    for doc_id, text, *_ in sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is not None:
            if text in first:
                want.append((doc_id, first[text]))
            first.setdefault(text, doc_id)
    got = exact.exact_duplicates(docs)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(odd_rows()) - len(want)


def test_exact_stages_leave_fewer_rows(spark):
    """Only rows of a shared length have their prefix hashed, and only those of a shared prefix their whole text."""
    long = prose(400, 9)
    texts = ["alone", "same length 1", "same length 2", long + "a", long + "b", long + "b", None, "alone too"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in exact.refined(docs, docs.select("doc_id", "text")).collect()}
    assert [i for i, r in rows.items() if r.by_length] == [1, 2, 3, 4, 5]
    assert [i for i, r in rows.items() if r.by_prefix] == [3, 4, 5]
    assert [i for i, r in rows.items() if r.full] == [3, 4, 5]
    assert {(r.doc_id, r.duplicate_of) for r in exact.exact_duplicates(docs).collect()} == {(5, 4)}


def test_exact_survives_a_full_bitmap(spark, monkeypatch):
    """With one bit for many keys rows pass by chance, and results are the same."""
    monkeypatch.setattr(common, "MAP_BITS", 3)
    texts = [prose(3 + i % 40, i % 60) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {(r.doc_id, r.duplicate_of) for r in exact.exact_duplicates(docs).collect()} == {(i, first[t]) for i, t in enumerate(texts) if first[t] != i}
    assert {r.doc_id for r in exact.drop_exact_duplicates(docs).collect()} == set(first.values())


def test_exact_ties(spark):
    """Of rows that differ in other columns only one stays, the same one whatever their order."""
    rows = [(1, "twice", "en", "a", 1), (1, "twice", "de", "b", 2), (1, "twice", "de", "b", 2), (2, "twice", "en", "a", 1), (None, "twice", "en", "a", 1)]
    kept = [exact.drop_exact_duplicates(spark.createDataFrame(r, SCHEMA)).collect() for r in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0][0].doc_id == 1
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.duplicate_of) for r in got), key=str) == [(1, 1), (1, 1), (2, 1), (None, 1)]


def test_exact_needs_whole_texts(spark):
    long = prose(500, 9)
    rows = [(i, long[:-1] + c, "en", "a", 1) for i, c in enumerate("aab")]
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert [(r.doc_id, r.duplicate_of) for r in got.collect()] == [(1, 0)]


def test_empty_tables(spark):
    docs = empty(spark)
    assert exact.exact_duplicates(docs).count() == 0
    assert exact.drop_exact_duplicates(docs).columns == docs.columns
    assert setsketch.near_duplicates(docs).count() == 0
    assert setsketch.drop_near_duplicates(docs).count() == 0
    assert compression.compression_quality(docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    for driver_edges in (0, 1000):
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), driver_edges).collect()))
        assert got == {n: find(n) for n in parent if find(n) != n}
    star = [(0, i) for i in range(1, 400)] + [(5, 5), (5, 0)]
    assert dict(map(tuple, connected_components(spark.createDataFrame(star, "a long, b long"), 0).collect())) == dict.fromkeys(range(1, 400), 0)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
            both = int(share * 600)
            x, y = pool[:600], np.concatenate([pool[:both], pool[600 : 600 + 600 - both]])
            truth = both / (1200 - both)
            got = setsketch.estimate(setsketch.registers(x)[None].astype(int), setsketch.registers(y)[None].astype(int), np.array([600.0]), np.array([600.0]))[0]
            errors.append(got - truth)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.07


def test_registers_merge():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    assert (setsketch.registers(np.concatenate([x, y])) == np.maximum(setsketch.registers(x), setsketch.registers(y))).all()


def test_crossed_pairs_against_all(spark, monkeypatch):
    """Blocks of a bucket meet in every pair, whatever sizes and numbers, and only across components."""
    monkeypatch.setattr(setsketch, "BLOCK_NODES", 4)
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [pool[: int(n)] for n in rng.integers(60, 400, 30)]
    nodes = spark.createDataFrame([(i, len(s), bytearray(setsketch.registers(s).tobytes())) for i, s in enumerate(sets)], "node long, n int, registers binary")
    mixed = spark.createDataFrame([(b, i, i % 5) for b in (1, 2) for i in range(30)] + [(3, 7, 1)], "bucket long, node long, root long")
    got = {(r.a, r.b): r.est for r in setsketch._crossed(mixed, nodes, 0.5, 0.6).collect()}
    for i, j in itertools.combinations(range(30), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if i % 5 == j % 5 or small < 0.6 * large:
            assert (i, j) not in got
        elif small > 0.75 * large:
            assert abs(got[i, j] - small / large) < 0.2


def _brute(rows, threshold=setsketch.THRESHOLD):
    sets = [set(shingle_hashes(*next(word_batches([t or ""]))[1:], setsketch.SHINGLE)[0].tolist()) for _, t, *_ in rows]
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def test_near_against_brute_force(spark):
    rows, r = [], random.Random(8)
    for g in range(12):
        base = prose(r.randint(20, 250), 100 + g).split(" ")
        for _ in range(r.randint(1, 14)):
            words = [w if r.random() > 0.04 else prose(1, r.randrange(10**6)) for w in base]
            rows.append((len(rows), " ".join(words), "en", "a", 1))
    rows += [(len(rows) + i, prose(100, 900 + i), "en", "a", 1) for i in range(40)]
    root = {i: i for i, *_ in rows} | {d: o for d, o in setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    pairs = _brute(rows)
    assert len(pairs) > 100
    assert sum(root[i] == root[j] for i, j in pairs) >= 0.9 * len(pairs)
    near = {i for p in pairs for i in p}
    assert all(root[i] == i for i in root if i not in near)
    groups = Counter(root.values())
    kept = setsketch.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id for r in kept.collect()} == set(groups)


@pytest.mark.parametrize("make", [odd, clashing])
def test_near_odd_rows(spark, make):
    docs = make(spark)
    kept = setsketch.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] for r in kept.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, None]
    pairs = {tuple(r) for r in setsketch.near_duplicates(docs).collect()}
    assert pairs == {(2, 1), (3, 1), (None, None)}


def test_compression_against_measure(spark):
    got = compression.compression_quality(odd(spark)).collect()
    want = [(r[0], *compression.measure(r[1])) for r in odd_rows()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r)[:7] for r in got], key=key) == sorted(want, key=key)
    assert all(r.keep == (r.reason is None) for r in got)


def _plain_judgement(text):
    """The rule again, from its description: ratios of the whole and of pieces that cover it."""
    import zstandard

    if not text:
        return "null" if text is None else "empty"
    raw = text.encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b))
    for upto, least, most in compression.BANDS:
        if len(raw) < upto:
            break
    if not least <= ratio(raw) <= most:
        return "repetitive" if ratio(raw) > most else "incompressible"
    starts = [*range(0, len(raw) - 2047, 2048)]
    if len(raw) % 2048:
        starts.append(len(raw) - 2048)
    pieces = [ratio(raw[s : s + 2048]) for s in starts] if len(raw) > 2048 else []
    for name, bad in (("repetitive", [r for r in pieces if r > 4.0]), ("incompressible", [r for r in pieces if r < 1.3])):
        if 10 * len(bad) > 3 * len(pieces):
            return f"{name} chunks"
    return None


def test_compression_against_brute_force(spark):
    noise = "".join(random.Random(2).choices([chr(c) for c in range(33, 127)], k=3000))
    texts = [None, "", "a" * 31, "a" * 127, "a" * 200, "b" * 5000, noise, noise[:100], prose(20, 1), prose(330, 1) + " " + noise[:1900], prose(300, 2) + "z" * 2500, prose(1400, 6) + "z" * 6200, prose(900, 3), prose(2000, 4) + noise, *[prose(n, n) for n in range(1, 60, 7)], *[t for _, t, *_ in odd_rows()]]
    got = compression.compression_quality(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    want = [_plain_judgement(t) for t in texts]
    assert [r.reason for r in got] == want and [r.keep for r in got] == [w is None for w in want]
    assert {"null", "empty", "repetitive", "incompressible", "repetitive chunks", "incompressible chunks", None} == set(want)
    assert want[3] == want[2] == "repetitive"


def test_compression_judges():
    noise = "".join(random.Random(1).choices([chr(c) for c in range(33, 127)], k=6000))
    assert compression.measure("again and again " * 200)[-1] == "repetitive"
    assert compression.measure(noise)[-1] == "incompressible"
    assert compression.measure(prose(3000, 5))[-1] is None
    assert compression.measure(prose(1500, 5) + " spam" * 4000)[-1] in ("repetitive", "repetitive chunks")
    assert compression.measure("short") == (5, compression.measure("short")[1], 0, 0, 0, None)


def test_compression_filter_keeps_columns(spark):
    docs = clashing(spark)
    kept = compression.compression_filter(docs)
    assert kept.columns == docs.columns
    assert None not in [r[1] for r in kept.collect()]
    assert edited("a b", 1) == "changed changed"
