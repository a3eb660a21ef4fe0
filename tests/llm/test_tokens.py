import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, curve, mixing, tokens, tokenstore
from tests.llm.cases import SCHEMA, clashing, empty, odd, odd_rows, prose

ENC = tokens.encoder()


def _docs(spark, n=60):
    return spark.createDataFrame([(i, prose(20 + 37 * i % 900, i), "en", "abc"[i % 3 if i % 5 else 0], 1) for i in range(n)], SCHEMA)


def test_encoder_round_trip():
    for _, text, *_ in odd_rows():
        assert ENC.decode(ENC.encode(text).tobytes()) == (text or "")


def test_blocks_hold_every_token(spark):
    docs = _docs(spark)
    blocks = mixing.pack_blocks(docs, 128).collect()
    assert all(len(b.tokens) == 256 and b.n_tokens <= 128 for b in blocks)
    assert sum(b.n_tokens for b in blocks) == sum(len(ENC.encode(r.text)) + 1 for r in docs.collect())
    parts = {}
    for b in blocks:
        ids, at = np.frombuffer(b.tokens, "<u2"), 0
        assert len({s.doc_id % 3 if s.doc_id % 5 else 0 for s in b.segments}) == 1
        for s in b.segments:
            parts.setdefault(s.doc_id, []).append((s.start, ids[at : at + s.n_tokens]))
            at += s.n_tokens
            at += at < b.n_tokens and ids[at] == ENC.eot
    for r in docs.collect():
        whole = np.concatenate([p for _, p in sorted(parts[r.doc_id], key=lambda p: p[0])])
        assert (whole == ENC.encode(r.text)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 99):
        got = mixing.permuted(np.arange(n), n, np.full(n, key, dtype=np.uint64))
        assert sorted(got) == list(range(n))


def test_mixture_reaches_weights(spark):
    docs = _docs(spark)
    mixed = mixing.mix_blocks(docs, {"a": 0.2, "b": 0.5, "c": 0.3, "none": 9.0}, epochs=6.0, block_tokens=64, shard_slots=32)
    rows = mixed.select("shard", "slot", "source", "epoch", "block").collect()
    totals = {r.source: r["count"] for r in mixing.pack_blocks(docs, 64).groupBy("source").count().collect()}
    assert len(rows) == round(6 * sum(totals.values()))
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    for s, w in {"a": 0.2, "b": 0.5, "c": 0.3}.items():
        own = [r for r in rows if r.source == s]
        assert abs(len(own) / len(rows) - w) < 0.05
        assert len({(r.epoch, r.block) for r in own}) == len(own)  # no block twice in an epoch
        last = max(r.epoch for r in own)
        assert all({r.block for r in own if r.epoch == e} == set(range(totals[s])) for e in range(last))
        assert {r.block for r in own} <= set(range(totals[s]))


def test_weights_hold_by_tokens(spark):
    """A rare source has some tokens in each of 64 input splits, far fewer than a block."""
    rows = [(i, prose(30 if i % 4 == 0 else 900, i), "en", "r" if i % 4 == 0 else "b", 1) for i in range(256)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(64)
    blocks = mixing.pack_blocks(docs, 512).groupBy("source").agg(F.avg("n_tokens").alias("n")).collect()
    assert all(r.n > 512 / 2 for r in blocks)
    for want in (0.5, 0.1):
        mixed = mixing.mix_blocks(docs, {"r": want, "b": 1 - want}, epochs=20.0, block_tokens=512).groupBy("source").agg(F.sum("n_tokens").alias("n"))
        tokens_of = {r.source: r.n for r in mixed.collect()}
        assert abs(tokens_of["r"] / sum(tokens_of.values()) - want) < 0.02


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix_blocks(_docs(spark))


def test_mixed_documents_are_cut_at_characters(spark):
    rows = [(i, "漢字 é😀 " * (30 + i), "zh", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = mixing.mix_documents(docs, block_tokens=50, epochs=1.0)
    assert got.columns == docs.columns
    found = got.collect()
    assert all("�" not in r.text and r.n_chars == len(r.text) for r in found)
    assert sum(r.n_chars for r in found) == sum(len(r[1]) for r in rows)


def test_mixing_odd_tables(spark):
    assert mixing.mix_blocks(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0
    assert mixing.mix_blocks(odd(spark), {"nowhere": 1.0}).count() == 0
    for docs in (odd(spark), clashing(spark)):
        rows = mixing.mix_blocks(docs, {"": 1.0}, block_tokens=64).collect()
        assert rows and {r.source for r in rows} == {""}


def test_hilbert_is_a_curve():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    key = curve.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def _check_packing(docs, rows, size):
    parts = {}
    for r in rows:
        ids, at = np.frombuffer(r.tokens, "<u2"), 0
        assert r.n_tokens == len(ids) == sum(r.lengths) <= size
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            parts.setdefault(d, []).append((s, ids[at : at + n].tolist()))
            at += n
    want = {}
    for doc_id, text in docs:
        if text:
            ids = [*ENC.encode(text).tolist(), ENC.eot]
            want.setdefault(doc_id, []).extend((s, ids[s : s + size]) for s in range(0, len(ids), size))
    assert {d: sorted(p) for d, p in parts.items()} == {d: sorted(p) for d, p in want.items()}


def test_packing_round_trip(spark):
    docs = _docs(spark)
    got = curve.pack_along_curve(docs, 256).collect()
    assert len({r.seq for r in got}) == len(got)
    _check_packing([(r.doc_id, r.text) for r in docs.collect()], got, 256)
    for make in (odd, clashing):
        _check_packing([r[:2] for r in odd_rows()], curve.pack_along_curve(make(spark)).collect(), curve.SEQUENCE_TOKENS)
    assert curve.pack_along_curve(empty(spark)).count() == 0


def test_neighbours_are_alike(spark):
    """Documents of two vocabularies share fewer sequences than chance would have them."""
    rows = []
    for i in range(200):
        text = prose(60, i % 2 + 5_000) if i % 4 < 2 else prose(60, i % 2 + 6_000)
        rows.append((i, " ".join(sorted(text.split(" "), key=lambda w: zlib.crc32(f"{w} {i}".encode()))), "en", "a", 1))
    got = curve.pack_along_curve(spark.createDataFrame(rows, SCHEMA), 1024).collect()
    mixed = sum(len({i % 4 for i in r.doc_ids}) > 2 for r in got)
    assert mixed <= len(got) / 2


def test_store_round_trip(spark):
    for make in (odd, clashing, _docs):
        docs = make(spark)
        path = common.new_path(spark, "store")
        index = tokenstore.write_tokens(docs, path)
        assert index.select(F.countDistinct("dict_hash")).first()[0] == 1
        got = sorted((str(r.doc_id), ENC.decode(r.tokens)) for r in tokenstore.read_tokens(index, path).collect())
        assert got == sorted((str(r[0]), r[1] or "") for r in docs.collect())
    row = index.orderBy("doc_id").first()
    store = tokenstore.TokenStore(path)
    assert ENC.decode(store.read(row.shard, row.offset, row.n_bytes, row.dict_hash).tobytes()) == docs.where(f"doc_id = {row.doc_id}").first().text
    with pytest.raises(ValueError):
        store.read(row.shard, row.offset, row.n_bytes, "other")
    assert tokenstore.write_tokens(empty(spark)).count() == 0


def test_dictionary_is_trained_on_every_document(spark, monkeypatch):
    """Through several levels of merging; it helps, and a phrase of any part of the table is in it."""
    import zstandard

    monkeypatch.setattr(tokenstore, "TRAINING_BYTES", 4000)
    monkeypatch.setattr(tokenstore, "MERGED", 3)
    phrase = prose(40, 77)
    docs = spark.createDataFrame([(i, prose(30, i) + " " + phrase + " " + prose(30, 500 + i), "en", "a", 1) for i in range(200)], SCHEMA).repartition(8)
    path = common.new_path(spark, "store")
    index = tokenstore.write_tokens(docs, path)
    raw = sum(len(ENC.encode(r.text).tobytes()) for r in docs.collect())
    alone = sum(len(zstandard.compress(ENC.encode(r.text).tobytes(), 3)) for r in docs.collect())
    assert index.agg(F.sum("n_bytes")).first()[0] < 0.9 * alone < raw
    got = {r.doc_id: ENC.decode(r.tokens) for r in tokenstore.read_tokens(index, path).collect()}
    assert got == {r.doc_id: r.text for r in docs.collect()}


def test_store_keeps_the_type_of_its_ids(spark, tmp_path):
    """A vocabulary beyond 65,535 ids takes four bytes each."""
    pieces = [bytes([b]) for b in range(256)] + [f"<{i}>".encode() for i in range(66_000)]
    vocabulary = tmp_path / "large.tiktoken"
    vocabulary.write_text("\n".join(f"{base64.b64encode(p).decode()} {i}" for i, p in enumerate(pieces)))
    docs = spark.createDataFrame([(1, "plain text", "en", "a", 1), (2, None, "en", "a", 1)], SCHEMA)
    path = common.new_path(spark, "store")
    index = tokenstore.write_tokens(docs, path, str(vocabulary))
    large = tokens.encoder(str(vocabulary))
    assert large.dtype == np.dtype("<u4")
    assert {r.doc_id: large.decode(r.tokens) for r in tokenstore.read_tokens(index, path).collect()} == {1: "plain text", 2: ""}
    row = index.where("doc_id = 1").first()
    assert row.n_tokens == 10 and len(tokenstore.TokenStore(path).read(row.shard, row.offset, row.n_bytes, row.dict_hash)) == 10
