"""Edge cases of the readers, by their outlines."""

import json

import pytest

from tessella import api, sinks
from tessella.cli import main
from tessella.errors import UnsupportedExtensionError, UnsupportedFormatError
from tessella.functions.docstrings import parse_doc
from tessella.functions.text import anchor, generate_id, position, sanitize_id
from tessella.plans import config, markup, nested
from tessella.plans.code.outline import read
from tessella.schema import SYMBOL_KINDS, with_typed_metadata
from tessella.sources.files import extension, read_documents
from tessella.streaming.incremental import outline_stream


def _docs(spark, *texts, ext="x"):
    return spark.createDataFrame([(str(i), ext, t) for i, t in enumerate(texts)], "doc_id string, ext string, content string")


def _outline(plan, spark, text, **options):
    """(depth, type, title, line) of one document's nodes."""
    return [(r.depth, r.type, r.title, r.line) for r in plan(_docs(spark, text), **options).orderBy("node_id").collect()]


def test_markdown_lines_and_ends(spark):
    assert _outline(markup.markdown, spark, "# a\r\n## b") == [(2, "heading", "b", None)]
    assert _outline(markup.markdown, spark, "---\nx: 1\n---\n# T\n", include_line_numbers=True) == [(1, "heading", "T", 1)]
    assert _outline(markup.markdown, spark, "---\nx: 1\n---\n\n# T\n", include_line_numbers=True) == [(1, "heading", "T", 2)]
    assert _outline(markup.markdown, spark, "```\n# code\n```\n# T") == [(1, "heading", "code", None), (1, "heading", "T", None)]
    assert _outline(markup.markdown, spark, "```\n# code\n```\n# T", strict=True) == [(1, "heading", "T", None)]
    assert _outline(markup.markdown, spark, "####### seven\n#no\n#\u00a0wide ") == [(1, "heading", "wide", None)]


def test_frontmatter_is_shown_on_line_one(spark):
    row = markup.markdown(_docs(spark, "---\nx: 1\n---\n# T\n# U")).orderBy("node_id").collect()
    assert json.loads(row[0].metadata)["frontmatter"] == "x: 1" and "frontmatter" not in json.loads(row[1].metadata)


@pytest.mark.parametrize("end", ["\r\n", "\r", "\n"])
def test_line_ends(spark, end):
    assert _outline(markup.asciidoc, spark, end.join(["= A", "== B", "[source, ruby]"])) == [(1, "heading", "A", 1), (2, "heading", "B", 2), (3, "block", "source", 3)]
    assert _outline(config.ini, spark, end.join(["[s]", "k = v"])) == [(1, "section", "s", 1), (2, "property", "k", 2)]


def test_latex(spark):
    text = "\\subsection{A {x} y}\n50\\% \\begin{figure} % \\begin{table}\n\\subsubsection*{B}\\begin{proof}\n\\section{C}"
    assert _outline(markup.latex, spark, text) == [(2, "section", "A {x", 1), (3, "environment", "figure", 2), (3, "section", "B", 3), (1, "section", "C", 4)]


def test_org_depth_is_unbounded(spark):
    assert _outline(markup.org, spark, "* a\n*********** b\n#+begin_src\n** c") == [(1, "heading", "a", 1), (11, "heading", "b", 2), (12, "block", "SRC", 3), (2, "heading", "c", 4)]


def test_rst_consumes_adornments(spark):
    assert _outline(markup.rst, spark, "A\n==\n==\nB\n==\nshort title\n---\n") == [(1, "heading", "A", 1), (2, "heading", "B", 4)]
    assert _outline(markup.rst, spark, "****\nTop\n****\n\nOne\n***\n\nTwo\n---\n\nNext\n****\n") == [(1, "heading", "Top", 2), (2, "heading", "One", 5), (3, "heading", "Two", 8), (2, "heading", "Next", 11)]


def test_wiki_normalises_levels(spark):
    assert _outline(markup.wiki, spark, "=== a ===\n==b==\n====c== ==") == [(2, "heading", "a", 1), (1, "heading", "b", 2), (1, "heading", "==c== ==", 3)][:2] + [(1, "heading", "==c==", 3)]


def test_html(spark):
    page = '<h2 id="i">A &amp; <b>b</b></h2><!-- <h1>no</h1> --><section class="c d"></section><h3></h3><main id=m>'
    rows = markup.html(_docs(spark, page)).orderBy("node_id").collect()
    assert [(r.title, r.type, r.depth, r.id, r.anchor) for r in rows] == [("A & b", "heading", 2, "i", "i"), ("c d", "section", 1, "section-c-d", None), ("m", "section", 1, "section-m", "m")]


def test_properties(spark):
    rows = config.properties(_docs(spark, "a=1\\\n  2\n# c \\\nb: 'x'\nexport C=\"y\nlast=1\\")).orderBy("node_id").collect()
    assert [(r.title, json.loads(r.metadata)["value"], r.line) for r in rows] == [("a", "1  2", 1), ("b", "x", 4), ("C", '"y', 5), ("last", "1\\", 6)]


CSV_LINES = [('a,b', ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('"a ""q"" b",', ['a "q" b', ""]), ('x"y,z"w,1', ["xy,zw", "1"]), ('"","""",b', ["", '"', "b"]), ('"open,a', ["open,a"]), (' " pad " , q ', ["pad", "q"])]


@pytest.mark.parametrize("line,fields", CSV_LINES)
def test_csv_fields(spark, line, fields):
    got = spark.createDataFrame([(line,)], "line string").select(config.csv_fields(config.F.col("line"), ",").alias("f")).first().f
    assert got == fields


def test_csv_types(spark):
    text = "n;d;u;x;e\n0x1f;2021-01-02;http://a;1;\n1e3;01/02/2021;mailto:b;word;\n-5;2021-13-02;c:d;2021-01-01;\n.5;2021/12/31;e:f;x@y.z;\nInfinity;31.12.2021;g:h;z;"
    got = {r.name: r for r in config.csv_profile(_docs(spark, text)).collect()}
    assert {n: r.type for n, r in got.items()} == {"n": "number", "d": "string", "u": "url", "x": "mixed", "e": "string"}
    assert got["e"].nullable and got["e"].unique_values == 0 and got["e"].min_length is None
    assert config.csv_profile(_docs(spark, "", " \n ")).count() == 0


def test_csv_without_header(spark):
    got = config.csv_profile(_docs(spark, "1,2\n3,4\n5,6")).orderBy("index").collect()
    assert [(r.name, r.type, r.unique_values, r.min, r.max) for r in got] == [("Column_1", "number", 3, 1.0, 5.0), ("Column_2", "number", 3, 2.0, 6.0)]


@pytest.mark.parametrize("parse,text", [(nested.parse_json, "{"), (nested.parse_yaml, "a: [1"), (nested.parse_yaml, "a: 1\na: 2"), (nested.parse_xml, "<a><b></a>"), (nested.parse_json, "[NaN]")])
def test_parse_errors(parse, text):
    with pytest.raises(ValueError, match="Invalid"):
        parse(text)


def test_error_modes(spark):
    docs = _docs(spark, "{", '{"a": 1}', ext="json")
    assert [r.doc_id for r in api.outline(docs, mode="PERMISSIVE", only=["json"]).collect()] == ["1"]
    assert [r.doc_id for r in api.parse_errors(docs).collect()] == ["0"]
    with pytest.raises(Exception, match="Invalid JSON"):
        api.outline(docs, only=["json"]).collect()


def test_registry(spark):
    assert {"md", "py", "toml", "mediawiki", "env", "gemspec"} <= set(api.extensions()) and api.is_supported("MD") and not api.is_supported("pdf")
    with pytest.raises(UnsupportedExtensionError, match="No generator found for file extension: pdf"):
        api.outline(_docs(spark, "x"), only=["pdf"])
    api.register_extension("Custom", lambda docs, max_depth=None: markup.markdown(docs, max_depth))
    try:
        assert api.outline(_docs(spark, "# a", ext="custom"), only=["custom"]).count() == 1
    finally:
        del api._registry["custom"]
    with pytest.raises(UnsupportedFormatError, match="ascii-tree, csv"):
        sinks.format_outline(markup.markdown(_docs(spark, "# a")), "pdf")
    assert sinks.formats() == sorted(sinks.formats()) and len(sinks.formats()) == 11


def test_empty_documents_have_empty_formats(spark):
    docs = _docs(spark, "no headings")
    nodes = markup.markdown(docs)
    for name in sinks.formats():
        assert sinks.format_outline(nodes, name, docs).count() == 1
        assert sinks.format_outline(nodes, name).count() == 0


def test_identifiers(spark):
    row = spark.createDataFrame([("Héllo, my  World -x-", 3)], "t string, n int").select(
        generate_id(config.F.col("t"), config.F.lit("heading"), config.F.col("n")).alias("id"), anchor(config.F.col("t")).alias("anchor"), sanitize_id(config.F.lit("1-a")).alias("safe"), position(config.F.lit("ab\ncd"), config.F.lit(4)).alias("at")
    ).first()
    assert (row.id, row.anchor, row.safe, tuple(row["at"])) == ("heading-h-llo--my--world--x--3", "hllo-my-world-x", "_1_a", (2, 2))


def _defs(ext, text):
    s, defs, _ = read(text, ext)
    return [(d.type, d.name, s.place(d.start)[0], d.parent) for d in defs]


def test_broken_code_is_read():
    assert _defs("py", "def f(:\n  x\nclass A:\n  def g(self):\n    pass\n") == [("function", "f", 1, None), ("class", "A", 3, None), ("method", "g", 4, 1)]
    assert _defs("ts", "class A {\n  run() {\n") == [("class", "A", 1, None), ("method", "run", 2, 0)]
    assert _defs("java", "class A { void f() { } } }} class B {") == [("class", "A", 1, None), ("method", "f", 1, 0), ("class", "B", 1, None)]
    for ext in api.extensions():
        if ext in ("ts", "js", "py", "java", "cs", "cpp", "go", "rs", "php", "kt", "swift", "scala", "rb", "lua"):
            for text in ("", "{", "}", "((", "class", "'\"`", "/*", "\x00", "def \nclass {\n", "é" * 5):
                read(text, ext)


def test_strings_and_comments_are_no_code():
    assert _defs("ts", "// class A {\nconst s = 'class B {';\n/* function c() {} */\nfunction d() { return `class E {${1}`; }") == [("function", "d", 4, None)]
    assert _defs("rb", "# class A\ns = 'def x'\ndef y\n  if a then b end\nend\ndef z = 1\n") == [("function", "y", 3, None), ("function", "z", 6, None)]
    assert _defs("rs", "fn f<'a>(c: char) -> bool { c == '{' }\nfn g() {}") == [("function", "f", 1, None), ("function", "g", 2, None)]


def test_python_parameters():
    _, defs, refs = read("from .x import y\nimport a as b, c.d\nclass K(B, metaclass=M):\n  @p\n  async def __f(self, a, /, b: int = 1, *args, k=2, **kw) -> int: 'doc'\n  _z: int\n", "py")
    f = defs[1]
    assert f.meta["visibility"] == "private" and f.meta["isAsync"] and f.docstring == "doc" and defs[0].meta["bases"] == ["B", "metaclass=M"]
    assert [p["name"] for p in f.meta["parameters"]] == ["a", "/", "b", "*args", "k", "**kw"]
    assert defs[2].meta == {"visibility": "protected", "dataType": "int"} and [r[1:] for r in refs] == [("imports", "c.d")]


def test_symbol_kinds(spark):
    docs = spark.createDataFrame([("a", "swift", "struct S { }\nenum E { case x }"), ("b", "kt", "interface I\nobject O"), ("c", "rs", "mod m {}\nimpl S {}\ntype X = u8;")], "doc_id string, ext string, content string")
    rows = api.symbols(docs).collect()
    assert {(r.name, r.kind) for r in rows} == {("S", "class"), ("E", "class"), ("x", "enum_member"), ("I", "class"), ("O", "class"), ("m", "module")}
    assert all(r.kind in SYMBOL_KINDS for r in rows)
    assert api.references(docs).count() == 0


def test_comments_attach(spark):
    text = "// far\n\n// one\n// two\nfunction f() {}\n\n/** @returns {T} x */\nexport class A {}\n"
    docs = spark.createDataFrame([("a", "ts", text)], "doc_id string, ext string, content string")
    rows = api.outline(docs, include_comments=True, only=["ts"]).orderBy("node_id").collect()
    meta = [json.loads(r.metadata) for r in rows]
    assert meta[0]["docstring"].split() == ["one", "two"] and meta[0]["doc"] == {"summary": "one two"}
    assert meta[1]["doc"] == {"returns": {"type": "T", "description": "x"}}
    assert with_typed_metadata(api.outline(docs, include_comments=True, only=["ts"])).orderBy("node_id").first().metadata.doc.summary == "one two"


@pytest.mark.parametrize("style,text,want", [("jsdoc", "@param [x=1] y", ("x", "=1] y")), ("pydoc", "S.\n\nArgs:\n    a: b", ("a", "b")), ("javadoc", "@param a", ("a", None))])
def test_doc_corners(spark, style, text, want):
    doc = spark.createDataFrame([(text,)], "t string").select(parse_doc(config.F.lit(style), config.F.col("t")).alias("d")).first().d
    assert (doc.params[0].name, doc.params[0].description) == want


def test_empty_doc(spark):
    assert spark.createDataFrame([(" \n",)], "t string").select(parse_doc(config.F.lit("jsdoc"), config.F.col("t")).alias("d")).first().d is None


def test_files_cli_and_stream(spark, tmp_path, capsys):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a b.md").write_text("# A\n## B\n")
    (tmp_path / "in" / "c.PY").write_text("def f(): g()\n")
    (tmp_path / "in" / ".env").write_text("A=1")
    (tmp_path / "in" / ".git" / "x.md").write_text("# no")
    docs = read_documents(spark, str(tmp_path / "in"), recursive=True)
    assert {(r.file_name, r.ext) for r in docs.collect()} == {("a b.md", "md"), ("c.PY", "py")}
    bare = spark.createDataFrame([("/x/.env",), ("/x/a.b/c",), ("/x/y.Env",)], "p string").select(extension(config.F.col("p")).alias("e"))
    assert [r.e for r in bare.collect()] == ["", "", "env"]
    assert {r.title for r in api.outline(docs, only=["md", "py"]).collect()} == {"A", "B", "f"}
    assert main(["outline", str(tmp_path / "in" / "a b.md"), "--max-depth", "1", "-l"]) == 0
    assert capsys.readouterr().out == "├─ A [heading] (line 1)\n\n"
    assert main(["symbols", str(tmp_path / "in" / "c.PY")]) == 0
    assert json.loads(capsys.readouterr().out)["references"] == [{"from": "f", "to": "g", "kind": "calls", "line": 1}]
    assert main(["outline", str(tmp_path / "none.md")]) == 1 and main(["outline", str(tmp_path / "in" / ".env")]) == 1
    assert main(["list-formats"]) == 0 and "mermaid" in capsys.readouterr().out

    source, out = tmp_path / "source", tmp_path / "out"
    for content in ("# A\n## B", "# A\n## B", "# C"):
        _docs(spark, content, ext="md").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id string, ext string, content string").parquet(str(source))
        outline_stream(stream, str(out), str(tmp_path / "check"), only=["md"]).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"{out}/nodes").collect()) == ["A", "B", "C"]
