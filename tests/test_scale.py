"""What must hold for large tables: work that grows with the input, and results as on small ones."""

import json
import time

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from tessella import api, catalog, sinks
from tessella.functions.docstrings import parse_doc_json
from tessella.plans import config, nested
from tessella.plans.code import outline as code

FILES = "doc_id string, ext string, file_name string, content string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_are_neither_joined_nor_shuffled(spark):
    text = "class A:\n    def f(self):\n        g()\n        g(); h()\n\n    def g(self): f(g())\nimport os\ng()\n"
    docs = spark.createDataFrame([("1", "PY", "a.py", text), ("2", "ts", None, "f(); class f { f() { f(); f(); } }"), ("3", "go", "c.go", "func f() { f() }")], FILES)
    refs = api.references(docs)
    assert "Join" not in _plan(refs) and "hashpartitioning" not in _plan(refs)
    assert sorted(tuple(r) for r in refs.collect()) == [
        ("1", 0, "A.f", "A.g", "calls", 3), ("1", 1, "A.f", "A.g", "calls", 4), ("1", 2, "A.f", "h", "calls", 4), ("1", 3, "A.g", "A.f", "calls", 6),
        ("1", 4, "A.g", "A.g", "calls", 6), ("1", 5, "a.py", "os", "imports", 7), ("1", 6, "a.py", "A.g", "calls", 8), ("2", 0, "<module>", "f", "calls", 1), ("2", 1, "f.f", "f", "calls", 1),
    ]


def test_edges_are_counted_without_a_join(spark):
    docs = spark.createDataFrame([("1", "py", "a.py", "f(); g()"), ("2", "TS", "b.ts", "f()"), ("3", "go", "c.go", "func f() { f() }"), ("4", None, None, "f()"), ("5", "py", "d.py", None)], FILES)
    counts = code.reference_counts(docs)
    assert sorted(tuple(r) for r in counts.collect()) == [("1", "py", 2), ("2", "TS", 1), ("3", "go", 0), ("4", None, 0), ("5", "py", 0)]
    query = catalog.QUERIES["edges_by_language"](spark, "/root/testdata/sf0.001")
    assert "Join" not in _plan(query) and "ENSURE_REQUIREMENTS" not in _plan(query)


def test_toml_symbols_take_time_in_proportion():
    def seconds(n):
        batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(n)], "content": ["[a]\nb = 1\nc = {d = 2}\n[a.e]\nf = 3\n"] * n})
        began = time.process_time()
        (out,) = code._mapped_toml(iter([batch]))
        assert out.num_rows == 6 * n and out.column("def_id").to_pylist() == [*range(6)] * n
        return time.process_time() - began

    seconds(100)
    assert seconds(4000) < 10 * seconds(1000)


@pytest.mark.parametrize("text", [lambda n: "k = {x = 1}\n" * n, lambda n: "k = {" + ", ".join(["k = {x = 1}"] * n) + "}\n"])
def test_inline_toml_tables_take_time_in_proportion(text):
    def seconds(n):
        began = time.process_time()
        (out,) = code._mapped_toml(iter([pa.RecordBatch.from_pydict({"doc_id": ["1"], "content": [text(n)]})]))
        assert out.num_rows - out.num_rows % 2 == 2 * n and out.column("name").to_pylist()[-2:] == ["k", "x"]
        return time.process_time() - began

    seconds(100)
    assert seconds(4000) < 10 * seconds(1000)


def test_doc_comments_are_split_once(spark):
    docs = spark.createDataFrame([("S.\n:param int a: b\n:type c: d\n:param c: e\n:param a:\n:rtype: R\n:returns: x",)], "t string")
    for style in ("pydoc", "jsdoc", "javadoc"):
        plan = docs.select(parse_doc_json(F.lit(style), F.col("t")).alias("doc"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("split(") <= 2
    doc = docs.select(parse_doc_json(F.lit("pydoc"), F.col("t")).alias("doc")).first().doc
    assert json.loads(doc) == {"summary": "S.", "params": [{"name": "a", "type": "int", "description": "b"}, {"name": "c", "type": "d", "description": "e"}], "returns": {"type": "R", "description": "x"}}


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PARTS_IN_TASK", 20)
    assert catalog.QUERIES["doc_attach_ts"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10


def test_yaml_is_written_and_read_fast_and_alike(monkeypatch):
    tree = [dict(title="C1", type="class", depth=1, children=[dict(title=t, type="y", metadata=dict(a=[], b=[dict(name="x: y"), dict(name="'q'")], c=True)) for t in ("run", "no", "a #b", "- x", "1", "", "l\nm", "é", "a -")])]
    want = yaml.dump(tree, Dumper=sinks._yaml_dumper(), sort_keys=False, allow_unicode=True, width=float("inf"))
    assert sinks._dump_yaml(tree) == want
    text = "name: a b\nsize: 3\ntags:\n  - yes\n  - {a: true}\nday: 2024-01-01\nnone:\n"
    nodes = [(n.title, n.kind, n.meta) for n in nested.parse_yaml(text)]
    assert [k for _, k, _ in nodes] == ["string", "number", "array", "object", "null"]
    monkeypatch.setattr(yaml.SafeLoader, "__init__", None)  # the slow reader
    monkeypatch.setattr(yaml, "dump", None)
    assert [(n.title, n.kind, n.meta) for n in nested.parse_yaml(text)] == nodes
    assert sinks._dump_yaml([dict(title="C1", type="class", children=[dict(title="run", line=3)])]) == "- title: C1\n  type: class\n  children:\n    - title: run\n      line: 3\n"
    began = time.process_time()
    assert not nested._YAML_PLAIN.fullmatch("- - - - x\n" * 2000 + "?")
    assert time.process_time() - began < 5


def test_documents_are_shuffled_once_before_they_are_made(spark):
    for name in ("fmt_csv", "tree_paths"):
        plan = _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan


def test_csv_cells_are_not_shuffled(spark):
    texts = ['n,q\n1,"a,b"\n2,"say ""x"""\n,\n', "a;b\n1;yes\n2;no\n3", "", None]
    profile = config.csv_profile(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, content string"))
    assert "Exchange" not in _plan(profile)
    got = sorted((r.doc_id, r["index"], r.name, r.type, r.nullable, r.sample_values, r.min, r.max, r.columns) for r in profile.collect())
    assert got == [("0", 0, "n", "number", True, ["1", "2"], 1.0, 2.0, 2), ("0", 1, "q", "string", True, ["a,b", 'say "x"'], None, None, 2), ("1", 0, "a", "number", False, ["1", "2", "3"], 1.0, 3.0, 2), ("1", 1, "b", "boolean", True, ["yes", "no"], None, None, 2)]


@pytest.mark.parametrize("line", ['a,b', '"a,b",c', 'a "x"y",z', '"""",""', '"open,a', ' " pad " ,　q ', '"a""b""",""","'])
def test_csv_fields_in_python_are_those_of_spark(spark, line):
    assert config._fields(line, ",") == spark.createDataFrame([(line,)], "t string").select(config.csv_fields(F.col("t"), ",").alias("f")).first().f


def test_types_are_counted_without_a_join(spark):
    assert "Join" not in _plan(catalog.QUERIES["corpus_type_counts"](spark, "/root/testdata/sf0.001"))


def test_overloads_are_grouped_within_a_document(spark):
    text = "class C {\n  int A(int a) { }\n  int A() { }\n  void B() {}\n}\nclass D { int A() => 1; }\n"
    docs = spark.createDataFrame([("1", "cs", None, text)], FILES)
    nodes = code.code_outline(docs, grouped=True, include_comments=True)
    assert "Exchange" not in _plan(nodes)
    got = [(r.node_id, r.parent_id, r.title, "overloads" in (r.metadata or "") and json.loads(r.metadata)["overloads"]) for r in nodes.collect()]
    assert got == [(0, None, "C", False), (1, 0, "A", 2), (2, 0, "B", False), (3, None, "D", False), (4, 3, "A", False)]
    assert [r.title for r in code.code_outline(docs, 1, grouped=True).collect()] == ["C", "D"]
