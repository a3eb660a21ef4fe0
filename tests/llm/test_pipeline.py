"""The pipeline's stages on their own inputs, against plain Python."""

import corpus_pipeline
from tessella.llm import compression, tokens
from tests.llm.cases import SCHEMA, clashing, edited, empty, odd_rows, prose

ENC = tokens.encoder()


def test_stages(spark, tmp_path):
    rows = odd_rows() + [(100 + i, edited(prose(200, 40), 30 + i), "en", "ab"[i % 2], 1) for i in range(4)] + [(200, "spam " * 3000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(at)))
        found.append(docs := spark.read.parquet(str(tmp_path / str(at))))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, exact, near, mixed, packed = [f.collect() for f in found]
    good = [r for r in rows if compression.measure(r[1])[-1] is None]
    assert sorted(map(str, map(tuple, quality))) == sorted(map(str, good)) and 200 not in {r.doc_id for r in quality}
    assert len(exact) == len({r.text for r in quality}) and {r.text for r in exact} == {r.text for r in quality}
    assert {r.doc_id for r in exact} >= {1, 3, 7, 8, 9, 11}
    assert sorted(str(r.doc_id) for r in near) == sorted(str(r.doc_id) for r in exact if r.doc_id not in (3, 101, 102, 103))
    whole = {r.text for r in near}
    assert mixed and all(any(r.text in t for t in whole) and r.n_chars == len(r.text) for r in mixed)
    assert sum(r.n_tokens for r in packed) == sum(len(ENC.encode(r.text)) + 1 for r in mixed)


def test_stages_bear_extra_columns_and_ties(spark, tmp_path):
    """Extra columns with clashing names stay as long as a stage keeps whole rows; of rows that
    differ in them only one stays."""
    docs = clashing(spark)
    rows = docs.collect()
    kept = spark.createDataFrame([*rows, *[(*r[:-1], "other") for r in rows if r[0] == 11]], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    ids = [r[0] for r in kept.collect()]
    assert sorted(ids, key=lambda i: (i is None, i or 0)) == [1, 7, 8, 9, 11, None]
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, str(tmp_path))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in mixed.collect()} <= set(ids)


def test_run(spark, tmp_path):
    spark.createDataFrame([(i, prose(120, i), "en", "ab"[i % 2], 1) for i in range(20)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
