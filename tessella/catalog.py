"""Registered queries of the outline engine, and DuckDB SQL with equal results.

Documents are made from the rows of tables by SQL that both engines take.  Spark parses them; the
SQL states what must come out from the rows' values, or parses them by other means.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import api, schema, sinks
from tessella.functions.docstrings import parse_doc_json
from tessella.functions.text import content_hash
from tessella.operators.tree import with_paths
from tessella.plans import config, markup, nested
from tessella.plans.code import outline as code
from tessella.samples import SAMPLES
from tessella.sources.files import read_documents
from tessella.streaming.incremental import changed

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
NL = "chr(10)"
PARTS_IN_TASK = 10_000


def _lines(*lines: str) -> str:
    """SQL of a text of lines, each a SQL string expression."""
    return f" || {NL} || ".join(f"({line})" for line in lines)


def _quoted(text: str) -> str:
    """SQL of a text with {k} for the key and {n} for the name."""
    out = "'" + text.replace("'", "''") + "'"
    out = out.replace("\\", "' || chr(92) || '")  # Spark takes a backslash for an escape
    return out.replace("{k}", "' || k || '").replace("{n}", "' || n || '")


_PARTS = "SELECT CAST(p_partkey AS STRING) AS k, p_name AS n, CAST(p_size AS STRING) AS z, p_partkey AS key FROM part"


def _corpus(ext: str, content: str) -> str:
    return f"SELECT k AS doc_id, '{ext}' AS ext, 'f' || k || '.{ext}' AS file_name, {content} AS content FROM ({_PARTS}) src"


def _documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        if f" {t}" in sql:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t == "part":  # a small file that many documents are made of: spread its rows, as many to a task at any size, by what is doc_id then
                rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // PARTS_IN_TASK)), F.col("p_partkey").cast("string"))
            rows.createOrReplaceTempView(t)
    return spark.sql(sql)


NODES = ["doc_id", "node_id", "parent_id", "title", "type", "depth", "line"]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, corpus: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(_documents(spark, sf_dir, corpus))
    if oracle:
        ORACLE_SQL[name] = oracle


# Markup: the SQL splits lines, takes what a pattern finds, and looks up parents one by one


def _line_oracle(corpus: str, items: str, depth: str = "depth", where: str = "true") -> str:
    """``items``: a select over ``lines`` of (doc_id, line, k, title, type, is_section, level)."""
    return f"""
        WITH docs AS ({corpus}),
        lines AS (SELECT doc_id, unnest(string_split(content, {NL})) AS text, generate_subscripts(string_split(content, {NL}), 1) AS line FROM docs),
        items AS ({items}),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS seq, {depth} AS own FROM items),
        parents AS (SELECT t.*, CASE WHEN t.is_section
            THEN (SELECT max(p.seq) FROM numbered p WHERE p.doc_id = t.doc_id AND p.seq < t.seq AND p.is_section AND p.own < t.own)
            ELSE (SELECT max(p.seq) FROM numbered p WHERE p.doc_id = t.doc_id AND p.seq < t.seq AND p.is_section) END AS parent FROM numbered t),
        nodes AS (SELECT c.*, CASE WHEN c.is_section THEN c.own ELSE coalesce(p.own, 0) + 1 END AS shown FROM parents c LEFT JOIN numbered p ON p.doc_id = c.doc_id AND p.seq = c.parent)
        SELECT doc_id, CAST(seq AS INTEGER) AS node_id, CAST(parent AS INTEGER) AS parent_id, title, type, CAST(shown AS INTEGER) AS depth, CAST(line AS INTEGER) AS line FROM nodes WHERE {where}"""


def _varied(mark: Callable[[int], str], *extra: str) -> str:
    """A text whose headings vary with the key in number and depth."""
    deep = f"CASE WHEN key % 3 = 0 THEN {mark(4).replace('TITLE', 'Deep')} || {NL} ELSE '' END"
    body = f"{mark(1).replace('TITLE', '{n}')}~{mark(2).replace('TITLE', 'Size')}"
    head = body.split("~")
    return " || ".join([_sub(head[0]), NL, _sub(head[1]), NL, "'text' || z", NL, _deep(deep), *[f"{_sub(e)} || {NL}" for e in extra], _sub(mark(3).replace("TITLE", "Part {k}")), NL, _sub(mark(2).replace("TITLE", "End")), NL])


def _sub(text: str) -> str:
    return _quoted(text)


def _deep(case: str) -> str:
    head, rest = case.split(" THEN ", 1)
    mark, tail = rest.split(f" || {NL}", 1)
    return f"{head} THEN {_quoted(mark)} || {NL}{tail}"


_MD = _corpus("md", _varied(lambda d: "#" * d + " TITLE"))
_MD_ITEMS = "SELECT doc_id, line, 0 AS k, trim(regexp_extract(text, '^(#{1,6})\\s+(.+)$', 2)) AS title, 'heading' AS type, true AS is_section, length(regexp_extract(text, '^(#{1,6})\\s+(.+)$', 1)) AS level FROM lines WHERE regexp_matches(text, '^#{1,6}\\s+.+$')"
_register("markdown_outline", _MD, lambda d: markup.markdown(d, include_line_numbers=True).select(*NODES), _line_oracle(_MD, _MD_ITEMS, "level"))
_register("markdown_maxdepth", _MD, lambda d: markup.markdown(d, 2, include_line_numbers=True).select(*NODES), _line_oracle(_MD, _MD_ITEMS + " AND length(regexp_extract(text, '^(#{1,6})', 1)) <= 2", "level"))

_ADOC = _corpus("adoc", _varied(lambda d: "=" * d + " TITLE", "[source,java]", "----", "[NOTE]"))
_register("asciidoc_outline", _ADOC, lambda d: markup.asciidoc(d).select(*NODES), _line_oracle(_ADOC, """
    SELECT doc_id, line, 0 AS k, CASE WHEN text LIKE '=%' THEN trim(ltrim(text, '=')) ELSE trim(string_split(trim(text, '[]'), ',')[1]) END AS title,
           CASE WHEN text LIKE '=%' THEN 'heading' ELSE 'block' END AS type, text LIKE '=%' AS is_section, length(text) - length(ltrim(text, '=')) AS level
    FROM lines WHERE regexp_matches(text, '^={1,6}\\s+.+$') OR regexp_matches(text, '^\\[[^\\]]+\\]\\s*$')""", "level"))

_WIKI = _corpus("wiki", _varied(lambda d: "=" * (d + 1) + " TITLE " + "=" * (d + 1), '<syntaxhighlight lang="c++">'))
_register("wiki_outline", _WIKI, lambda d: markup.wiki(d).select(*NODES), _line_oracle(_WIKI, """
    SELECT doc_id, line, 0 AS k, CASE WHEN text LIKE '=%' THEN trim(trim(text, '=')) ELSE 'syntaxhighlight' END AS title,
           CASE WHEN text LIKE '=%' THEN 'heading' ELSE 'block' END AS type, text LIKE '=%' AS is_section,
           CASE WHEN text LIKE '=%' THEN length(text) - length(ltrim(text, '=')) END AS level
    FROM lines WHERE text LIKE '==%' OR text LIKE '<syntax%'""", "level - min(level) OVER (PARTITION BY doc_id) + 1"))

_TEX = _corpus("tex", _varied(lambda d: "\\" + ("", "section", "subsection", "subsubsection", "paragraph")[d] + "{TITLE} % note", "\\begin{figure}\\begin{itemize}\\begin{table*}", "% \\section{no}"))
_register("latex_outline", _TEX, lambda d: markup.latex(d).select(*NODES), _line_oracle(_TEX, """
    SELECT doc_id, line, 0 AS k, trim(regexp_extract(text, '\\{(.+?)\\}', 1)) AS title, 'section' AS type, true AS is_section,
           CASE regexp_extract(text, '^\\\\(\\w+)', 1) WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 WHEN 'subsubsection' THEN 3 ELSE 4 END AS level
    FROM lines WHERE regexp_matches(text, '^\\\\(sub)*section|^\\\\paragraph')
    UNION ALL SELECT doc_id, line, k, title, 'environment', false, NULL FROM (SELECT doc_id, line, unnest(['figure', 'table']) AS title, unnest([1, 2]) AS k FROM lines WHERE text LIKE '\\begin%')""", "level"))

_ORG = _corpus("org", _varied(lambda d: "*" * d + (" TODO [#B] TITLE  :a:b:" if d == 3 else " TITLE"), "#+BEGIN_SRC python", "#+begin_quote"))
_register("org_outline", _ORG, lambda d: markup.org(d).select(*NODES, F.get_json_object("metadata", "$.todo").alias("todo"), F.get_json_object("metadata", "$.language").alias("language")), f"""
    SELECT n.*, CASE WHEN title LIKE 'Part %' THEN 'TODO' END AS todo, CASE WHEN title = 'SRC' THEN 'python' END AS language FROM ({_line_oracle(_ORG, '''
    SELECT doc_id, line, 0 AS k, CASE WHEN text LIKE '*%' THEN trim(replace(replace(ltrim(text, '*'), 'TODO [#B] ', ''), ':a:b:', '')) ELSE upper(regexp_extract(text, '_([A-Za-z]+)', 1)) END AS title,
           CASE WHEN text LIKE '*%' THEN 'heading' ELSE 'block' END AS type, text LIKE '*%' AS is_section, length(text) - length(ltrim(text, '*')) AS level
    FROM lines WHERE text LIKE '*%' OR text LIKE '#+%' ''', 'level')}) n""")

_RST = _corpus("rst", " || ".join([_quoted("=========="), NL, _quoted("T {k}"), NL, _quoted("=========="), NL, NL, _quoted("Size"), NL, _quoted("-----"), NL, _quoted(".. note:: about {n}"), NL, f"CASE WHEN key % 2 = 0 THEN 'Even' || {NL} || '~~~~~' || {NL} ELSE '' END", _quoted("End"), NL, _quoted("-----"), NL]))
_register("rst_outline", _RST, lambda d: markup.rst(d).select(*NODES), """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 2 = 0 AS even FROM part)
    SELECT k AS doc_id, 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, 'T ' || k AS title, 'heading' AS type, 1 AS depth, 2 AS line FROM p
    UNION ALL SELECT k, 1, 0, 'Size', 'heading', 2, 5 FROM p
    UNION ALL SELECT k, 2, 1, 'note', 'directive', 3, 7 FROM p
    UNION ALL SELECT k, 3, 1, 'Even', 'heading', 3, 8 FROM p WHERE even
    UNION ALL SELECT k, CASE WHEN even THEN 4 ELSE 3 END, 0, 'End', 'heading', 2, CASE WHEN even THEN 10 ELSE 8 END FROM p""")


def _expected(rows: list[tuple], columns: str = "") -> str:
    """SQL of nodes (parent, title, type, depth, line) for each part; more columns after those."""
    parts = []
    for i, (parent, title, kind, depth, line, *more) in enumerate(rows):
        place = "CAST(NULL AS INTEGER)" if line is None else line
        parts.append(f"SELECT k AS doc_id, {i} AS node_id, {'CAST(NULL AS INTEGER)' if parent is None else parent} AS parent_id, {_quoted(title)} AS title, '{kind}' AS type, {depth} AS depth, {place} AS line" + "".join(f", {m} AS {c}" for m, c in zip(more, columns.split())) + f" FROM ({_PARTS}) src")
    return " UNION ALL ".join(parts)


def _metadata(json_text: str | None) -> str:
    return _quoted(json_text) if json_text else "CAST(NULL AS VARCHAR)"


_INI = _corpus("ini", _lines(*map(_quoted, ("; note", "top = {k}", "[part {k}]", "name: {n}", "# skipped", "size=a=b", "[end]", "=nothing", "x:1"))))
def _of(key: str, name: str | None = None):
    """A metadata value as a column."""
    return F.get_json_object("metadata", f"$.{key}").alias(name or key)



_register("ini_outline", _INI, lambda d: config.ini(d).select(*NODES, _of("value")), _expected([(None, "top", "property", 1, 2, "k"), (None, "part {k}", "section", 1, 3, "NULL"), (1, "name", "property", 2, 4, "n"), (1, "size", "property", 2, 6, "'a=b'"), (None, "end", "section", 1, 7, "NULL"), (4, "x", "property", 2, 9, "'1'")], "value"))
_PROPERTIES = _corpus("properties", _lines(*map(_quoted, ("! note", "export key{k}=\"{n}\"", "long = one \\", "  two \\", "# three", "flag: 'on'", "none"))))
_register("properties_outline", _PROPERTIES, lambda d: config.properties(d).select(*NODES, _of("value")), _expected([(None, "key{k}", "property", 1, 2, "n"), (None, "long", "property", 1, 3, "'one   two # three'"), (None, "flag", "property", 1, 6, "'on'")], "value"))
_TOML = _corpus("toml", _lines(*map(_quoted, ('title = "{n}" # note', "[a]", "key = {k}", "[a.b.c]", "list = [1,", "  2]", "[[d]]", 'in = { x = 1, y = "q" }'))))
_register("toml_outline", _TOML, lambda d: nested.toml_outline(d).select(*NODES, _of("value")), _expected([(None, "title", "property", 1, 1, "'\"' || n || '\"'"), (None, "a", "section", 1, 2, "NULL"), (1, "key", "property", 2, 3, "k"), (1, "a.b.c", "section", 2, 4, "NULL"), (3, "list", "property", 3, 5, f"'[1,' || {NL} || '  2]'"), (None, "d", "section", 1, 7, "NULL"), (5, "in", "property", 2, 8, "'{ x = 1, y = \"q\" }'"), (6, "x", "property", 3, 8, "'1'"), (6, "y", "property", 3, 8, "'\"q\"'")], "value"))
_JSON = _corpus("json", _quoted('{"name": "{n}", "2": {k}, "1": null, "tags": [{"t": true}], "in": {"deep": {"x": []}}}'))
_register("json_outline", _JSON, lambda d: nested.json_outline(d).select(*NODES, _of("dataType", "data_type"), _of("path")), _expected([(None, "1", "property", 1, None, "'null'", "'1'"), (None, "2", "property", 1, None, "'number'", "'2'"), (None, "name", "property", 1, None, "'string'", "'name'"), (None, "tags", "property", 1, None, "'array'", "'tags'"), (3, "t", "property", 2, None, "'boolean'", "'tags[].t'"), (None, "in", "property", 1, None, "'object'", "'in'"), (5, "deep", "property", 2, None, "'object'", "'in.deep'"), (6, "x", "property", 3, None, "'array'", "'in.deep.x'")], "data_type path"))
_YAML = _corpus("yaml", _lines(*map(_quoted, ("name: {n}", "size: {k}", "tags:", "  - yes", "  - {a: true}", "none:"))))
_register("yaml_outline", _YAML, lambda d: nested.yaml_outline(d).select(*NODES, _of("path")), _expected([(None, "name", "string", 1, None, "'name'"), (None, "size", "number", 1, None, "'size'"), (None, "tags", "array", 1, None, "'tags'"), (2, "0", "string", 2, None, "'tags.0'"), (2, "1", "object", 2, None, "'tags.1'"), (4, "a", "boolean", 3, None, "'tags.1.a'"), (None, "none", "null", 1, None, "'none'")], "path"))
_XML = _corpus("xml", _quoted('<part id="{k}"><name>{n}</name><i><a>1</a></i><i><b>2</b></i><i/><i><c>4</c></i></part>'))
_register("xml_outline", _XML, lambda d: nested.xml_outline(d).select(*NODES, _of("path")), _expected([(None, "part", "element", 1, None, "'part'"), (0, "name", "text", 2, None, "'part.name'"), (0, "i", "array", 2, None, "'part.i'"), (2, "a", "text", 3, None, "'part.i[0].a'"), (2, "b", "text", 3, None, "'part.i[1].b'")], "path"))


# HTML pages

_PAGES = "SELECT CAST(page_id AS STRING) AS doc_id, 'html' AS ext, html AS content FROM pages"
_register("html_outline", _PAGES, lambda d: markup.html(d).select("doc_id", "node_id", "parent_id", "title", "type", "depth", "id", "anchor"), """
    WITH h AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM pages),
    s AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, t.title, strpos(html, '<' || t.title) AS spot FROM pages, (VALUES ('nav'), ('article'), ('footer')) t(title) WHERE contains(html, '<' || t.title)),
    anchors AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS anchor FROM h WHERE title <> '')
    SELECT doc_id, 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, title, 'heading' AS type, 1 AS depth, 'heading-' || regexp_replace(lower(title), '[^a-z0-9]', '-', 'g') AS id, anchor FROM anchors
    UNION ALL SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY spot) - CASE WHEN a.doc_id IS NULL THEN 1 ELSE 0 END AS INTEGER), NULL, s.title, 'section', 1, 'section-' || s.title, NULL FROM s LEFT JOIN anchors a ON a.doc_id = s.doc_id""")


# CSV: a table of each nation's customers

_CSV_ROWS = "SELECT CAST(c_nationkey AS STRING) AS doc_id, c_custkey, CAST(c_custkey AS STRING) || ';' || '\"' || c_name || '; x\";' || CAST(CAST(round(c_acctbal) AS BIGINT) AS STRING) || ';' || CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END || ';' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment || '@x.com' END AS row_text FROM customer"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir, _CSV_ROWS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row_text"))), lambda r: r["row_text"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("number;customer;balance;active;mail\n"), joined).alias("content")).withColumn("ext", F.lit("csv"))


QUERIES["csv_profile"] = lambda s, d: config.csv_profile(_tables(s, d)).select("doc_id", "index", "name", "type", "nullable", F.col("unique_values").cast("bigint").alias("unique_values"), "min_length", "max_length", "avg_length", "min", "max", F.array_join("sample_values", "|").alias("samples"))
_CSV_COLUMNS = (("number", "number", "CAST(c_custkey AS VARCHAR)"), ("customer", "string", "c_name || '; x'"), ("balance", "number", "CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR)"), ("active", "boolean", "CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END"), ("mail", "email", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment || '@x.com' END"))
ORACLE_SQL["csv_profile"] = " UNION ALL ".join(f"""
    SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, {i} AS "index", '{name}' AS name, '{kind}' AS type, bool_or(v IS NULL) AS nullable, count(DISTINCT v) AS unique_values,
      CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length, floor(avg(length(v)) * 100 + 0.5) / 100 AS avg_length,
      {'min(CAST(v AS DOUBLE))' if kind == 'number' else 'CAST(NULL AS DOUBLE)'} AS "min", {'max(CAST(v AS DOUBLE))' if kind == 'number' else 'CAST(NULL AS DOUBLE)'} AS "max",
      (SELECT string_agg(w, '|' ORDER BY f) FROM (SELECT w, f FROM (SELECT {sql.replace('c_', 'd.c_')} AS w, min(d.c_custkey) AS f FROM customer d WHERE d.c_nationkey = t.c_nationkey GROUP BY 1) WHERE w IS NOT NULL ORDER BY f LIMIT 5)) AS samples
    FROM (SELECT c_nationkey, {sql} AS v FROM customer) t GROUP BY c_nationkey""" for i, (name, kind, sql) in enumerate(_CSV_COLUMNS))
QUERIES["csv_dialect"] = lambda s, d: config.csv_tables(_tables(s, d)).select("doc_id", "delimiter", "has_header", F.size("rows").cast("bigint").alias("n_rows"))
ORACLE_SQL["csv_dialect"] = "SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, ';' AS delimiter, true AS has_header, count(*) + 1 AS n_rows FROM customer GROUP BY c_nationkey"
QUERIES["csv_outline"] = lambda s, d: config.csv(_tables(s, d)).select("doc_id", "node_id", "parent_id", "title", "type", "depth")
ORACLE_SQL["csv_outline"] = "WITH n AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS doc_id FROM customer) SELECT doc_id, 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, 'Columns' AS title, 'section' AS type, 1 AS depth FROM n" + "".join(f" UNION ALL SELECT doc_id, {i + 1}, 0, '{name}', '{kind} column', 2 FROM n" for i, (name, kind, _) in enumerate(_CSV_COLUMNS))


_TYPED = _corpus("csv", _lines(*map(_quoted, ("when,where,what,mixed,amount", "2024-01-05,https://x.com/{k},word,1,2", "31.12.2023,ftp://h/a?b={k},more {k},a@b.c,3", "2024/02/07,http://{k}.org,words,other,4", "01-02-2024,mailto:x,,2024-01-01,5", "12/31/2024,https://y.org,it,x,6 apples"))))
_register("csv_types", _TYPED, lambda d: config.csv_profile(d).select("doc_id", "index", "name", "type", "min", "max", "nullable"), " UNION ALL ".join(f"SELECT k AS doc_id, {i} AS \"index\", '{n}' AS name, '{t}' AS type, {lo} AS \"min\", {hi} AS \"max\", {nullable} AS nullable FROM ({_PARTS}) src" for i, (n, t, lo, hi, nullable) in enumerate((("when", "date", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "false"), ("where", "url", "NULL", "NULL", "false"), ("what", "string", "NULL", "NULL", "true"), ("mixed", "mixed", "NULL", "NULL", "false"), ("amount", "number", "2.0", "6.0", "false")))))


# Documents that can't be parsed, in each second file (a TOML document always gives what can be read of it)

_BROKEN = {"json": ('{"a": {k}}', '{"a": }'), "xml": ("<a><b>{k}</b></a>", "<a><b></a>"), "yaml": ("a: {k}", "a: [1")}
_BAD_FILES = " UNION ALL ".join(f"SELECT '{e}' || k AS doc_id, '{e}' AS ext, CASE WHEN key % 2 = 0 THEN {_quoted(bad)} ELSE {_quoted(good)} END AS content FROM ({_PARTS}) src" for e, (good, bad) in _BROKEN.items())
_register("parse_errors", _BAD_FILES, lambda d: api.parse_errors(d).select("doc_id", (F.length("error") > 0).alias("told")), " UNION ALL ".join(f"SELECT '{e}' || k AS doc_id, true AS told FROM ({_PARTS}) src WHERE key % 2 = 0" for e in _BROKEN))
_register("safe_outline", _BAD_FILES + f" UNION ALL SELECT 'u' || k, 'unknown', 'x' FROM ({_PARTS}) src", lambda d: api.outline(d, mode="PERMISSIVE").select("doc_id", "title"), " UNION ALL ".join(f"SELECT '{e}' || k AS doc_id, 'a' AS title FROM ({_PARTS}) src WHERE key % 2 = 1" for e in _BROKEN) + f" UNION ALL SELECT 'xml' || k, 'b' FROM ({_PARTS}) src WHERE key % 2 = 1")


# Code: a file for each part

_CODE: dict[str, tuple[tuple[str, ...], list[tuple]]] = {
    "ts": (("import { a } from 'm{k}';", "export class C{k} {", "  static v = 'class X {';", "  run(a: number, b?: string): string { return help(a); }", "  run2 = 1;", "}", "function help(x) { return x; }", "export const f{k} = (y) => help(y);"),
           [(None, 'C{k}', 'class', 1, 2, None), (0, 'v', 'property', 2, 3, '{"isStatic":true}'), (0, 'run', 'method', 2, 4, '{"parameters":[{"name":"a","type":"number"},{"name":"b","type":"string","optional":true}],"returnType":"string"}'), (0, 'run2', 'property', 2, 5, None), (None, 'help', 'function', 1, 7, '{"parameters":[{"name":"x"}]}'), (None, 'f{k}', 'function', 1, 8, '{"parameters":[{"name":"y"}]}')]),
    "js": (("class C{k} extends B {", "  go(a, b = 2) { return a; }", "}", "exports.f{k} = function () {};", "let g = async x => x;"), [(None, 'C{k}', 'class', 1, 1, None), (0, 'go', 'method', 2, 2, '{"parameters":[{"name":"a"},{"name":"b","optional":true,"defaultValue":"2"}]}'), (None, 'f{k}', 'function', 1, 4, '{"parameters":[]}'), (None, 'g', 'function', 1, 5, '{"parameters":[]}')]),
    "tsx": (("interface P { a: string }", "export const V{k} = ({ a }: P) => <b>{a}</b>;"), [(None, 'P', 'interface', 1, 1, None), (None, 'V{k}', 'function', 1, 2, '{"parameters":[{"name":"{ a }","type":"P"}]}')]),
    "py": (("import os", "from a.b import c", "class C{k}(Base):", "    size: int = 1", "    def _run(self, a: int, *b, c=2) -> str:", "        return help(a)", "async def help(x):", "    def inner(): pass", "    return c(x)"), [(None, 'C{k}', 'class', 1, 3, '{"bases":["Base"]}'), (0, 'size', 'property', 2, 4, '{"visibility":"public","dataType":"int"}'), (0, '_run', 'method', 2, 5, '{"visibility":"protected","parameters":[{"name":"a","type":"int"},{"name":"*b"},{"name":"c","optional":true,"defaultValue":"2"}],"returnType":"str"}'), (None, 'help', 'function', 1, 7, '{"visibility":"public","parameters":[{"name":"x"}],"isAsync":true}'), (3, 'inner', 'function', 2, 8, '{"visibility":"public","parameters":[]}')]),
    "java": (("package a.b;", "import c.d.E;", "public class C{k} {", "  private int x = 1; // int y;", "  public C{k}(int x) { this.x = x; }", "  static <T> void run(T t, String... s) throws E { if (x > 1) { go(t); } }", "  enum K { A, B }", "}"), [(None, 'a.b', 'package', 1, 1, None), (None, 'c.d.E', 'import', 1, 2, None), (None, 'C{k}', 'class', 1, 3, '{"visibility":"public"}'), (2, 'x', 'field', 2, 4, '{"visibility":"private","dataType":"int"}'), (2, 'C{k}', 'method', 2, 5, '{"visibility":"public","parameters":[{"name":"x","type":"int"}]}'), (2, 'run', 'method', 2, 6, '{"isStatic":true,"parameters":[{"name":"t","type":"T"},{"name":"String... s"}],"returnType":"void","typeParameters":"<T>"}'), (2, 'K', 'enum', 2, 7, None), (6, 'A', 'enum-value', 3, 7, None), (6, 'B', 'enum-value', 3, 7, None)]),
    "cs": (("namespace N.M {", "  public struct S{k} {", "    public int X { get; set; } = 1;", "    int y;", "    internal static void Run(int a) => Go(a);", "  }", "}"), [(None, 'N.M', 'namespace', 1, 1, None), (0, 'S{k}', 'struct', 2, 2, '{"visibility":"public"}'), (1, 'X', 'property', 3, 3, '{"visibility":"public","dataType":"int"}'), (1, 'y', 'field', 3, 4, '{"dataType":"int"}'), (1, 'Run', 'method', 3, 5, '{"visibility":"internal","isStatic":true,"parameters":[{"name":"a","type":"int"}],"returnType":"void"}')]),
    "cpp": (("#include <map>", "namespace n {", "struct S{k} {", "  int a;", "private:", "  virtual void run(int x) const;", "};", "int f{k}(int x) { return g(x); }", "}"), [(None, '<map>', 'include', 1, 1, None), (None, 'n', 'namespace', 1, 2, None), (1, 'S{k}', 'struct', 2, 3, None), (2, 'a', 'field', 3, 4, '{"visibility":"public","dataType":"int"}'), (2, 'run', 'method', 3, 6, '{"visibility":"private","isVirtual":true,"parameters":[{"name":"x","type":"int"}],"returnType":"void"}'), (1, 'f{k}', 'function', 2, 8, '{"parameters":[{"name":"x","type":"int"}],"returnType":"int"}')]),
    "go": (("package p", "type S{k} struct {", "  A, B int", "}", "func (s *S{k}) Run(a, b int, c string) (int, error) {", "  return 1, nil", "}", "func f() {}", "const (", "  X = 1", "  Y", ")"), [(None, 'S{k}', 'struct', 1, 2, '{"visibility":"public"}'), (0, 'A', 'field', 2, 3, '{"visibility":"public","dataType":"int"}'), (None, 'Run', 'method', 1, 5, '{"visibility":"public","parameters":[{"name":"a","type":"int"},{"name":"c","type":"string"}],"returnType":"(int, error)","receiver":"(s *S{k})"}'), (None, 'f', 'function', 1, 8, '{"visibility":"private","parameters":[]}'), (None, 'X', 'constant', 1, 9, None)]),
    "rs": (("pub struct S{k} { pub a: Vec<i32>, b: u8 }", "impl S{k} {", "  pub fn new(a: i32) -> Self { S { a } }", "}", "enum E { A, B(i32) }", "mod m { fn f<'a>(x: &'a str) {} }"), [(None, 'S{k}', 'struct', 1, 1, '{"visibility":"public"}'), (0, 'a', 'field', 2, 1, '{"visibility":"public","dataType":"Vec<i32>"}'), (0, 'b', 'field', 2, 1, '{"dataType":"u8"}'), (None, 'S{k}', 'impl', 1, 2, None), (3, 'new', 'method', 2, 3, '{"visibility":"public","parameters":[{"name":"a","type":"i32"}],"returnType":"Self"}'), (None, 'E', 'enum', 1, 5, None), (5, 'A', 'enum-value', 2, 5, None), (5, 'B', 'enum-value', 2, 5, None), (None, 'm', 'module', 1, 6, None), (8, 'f', 'function', 2, 6, '{"parameters":[{"name":"x","type":"&\'a str"}]}')]),
    "rb": (("module M", "  class C{k} < B", "    def self.run(a, b = 1)", "      if a then b end", "      list.each do |x| x end", "    end", "  end", "end", "def f{k}; end"), [(None, 'M', 'module', 1, 1, None), (0, 'C{k}', 'class', 2, 2, None), (1, 'run', 'method', 3, 3, '{"parameters":[{"name":"a"},{"name":"b","optional":true,"defaultValue":"1"}],"isStatic":true}'), (None, 'f{k}', 'function', 1, 9, '{"parameters":[]}')]),
    "php": (("<?php", "namespace A\\B;", "trait T{k} {", "  protected ?int $x = 1;", "  abstract public function go(int $a, string ...$b): void;", "}", "function f($y = 2) { return $y; }"), [(None, 'A\\B', 'namespace', 1, 2, None), (None, 'T{k}', 'trait', 1, 3, None), (1, 'x', 'property', 2, 4, '{"visibility":"protected","dataType":"?int"}'), (1, 'go', 'method', 2, 5, '{"visibility":"public","isAbstract":true,"parameters":[{"name":"$a","type":"int"},{"name":"$b","type":"string"}],"returnType":"void"}'), (None, 'f', 'function', 1, 7, '{"parameters":[{"name":"$y","optional":true,"defaultValue":"2"}]}')]),
    "kt": (("interface I { fun a(): Int }", "data class C{k}(val x: Int) : I {", "  private val y = 1", "  override fun a(): Int = help(y)", "}", "object O"), [(None, 'I', 'interface', 1, 1, None), (0, 'a', 'method', 2, 1, '{"parameters":[],"returnType":"Int"}'), (None, 'C{k}', 'class', 1, 2, None), (2, 'y', 'property', 2, 3, '{"visibility":"private"}'), (2, 'a', 'method', 2, 4, '{"parameters":[],"returnType":"Int"}'), (None, 'O', 'object', 1, 6, None)]),
    "swift": (("protocol P { func a() -> Int }", "struct S{k}: P {", "  let x: Int", "  func a() -> Int { return x }", "}", "enum E { case one, two }"), [(None, 'P', 'protocol', 1, 1, None), (0, 'a', 'method', 2, 1, '{"parameters":[],"returnType":"Int"}'), (None, 'S{k}', 'struct', 1, 2, None), (2, 'x', 'property', 2, 3, '{"dataType":"Int"}'), (2, 'a', 'method', 2, 4, '{"parameters":[],"returnType":"Int"}'), (None, 'E', 'enum', 1, 6, None), (5, 'one', 'enum-value', 2, 6, None)]),
    "scala": (("trait T { def a: Int }", "case class C{k}(x: Int) extends T {", "  def a: Int = x", "  private def b(y: String)(z: Int): Unit = { go(y) }", "}"), [(None, 'T', 'trait', 1, 1, None), (0, 'a', 'method', 2, 1, '{"parameters":[],"returnType":"Int"}'), (None, 'C{k}', 'class', 1, 2, None), (2, 'a', 'method', 2, 3, '{"parameters":[],"returnType":"Int"}'), (2, 'b', 'method', 2, 4, '{"visibility":"private","parameters":[{"name":"y","type":"String"}],"returnType":"Unit"}')]),
    "lua": (("local function f{k}(a, ...)", "  if a then return a end", "end", "function M.go(b)", "  for i = 1, 2 do print(i) end", "end"), [(None, 'f{k}', 'function', 1, 1, '{"parameters":[{"name":"a"},{"name":"..."}],"isLocal":true}'), (None, 'go', 'function', 1, 4, '{"parameters":[{"name":"b"}]}')]),
}
_CORPORA = {ext: _corpus(ext, _lines(*map(_quoted, lines))) for ext, (lines, _) in _CODE.items()}
for _ext, (_, _rows) in _CODE.items():
    _register(f"code_{_ext}", _CORPORA[_ext], lambda d: code.code_outline(d).select(*NODES, "metadata"), _expected([(*r[:5], _metadata(r[5])) for r in _rows], "metadata"))


def _included(i: int) -> str:
    """SQL of whether a part's file has the i-th snippet: all combinations occur."""
    return f"floor(key / {2**i}) % 2 = 1"


def _sampled(head: str, snippets: list[tuple]) -> tuple[str, str]:
    """SQL of files that have the snippets whose turn it is, and of their nodes."""
    content = _quoted(head) + f" || {NL}" if head else "''"
    nodes, lines = "0", "1" if head else "0"
    rows = []
    for i, (text, found) in enumerate(snippets):
        for at, (parent, title, kind, depth, line, meta) in enumerate(found):
            above = "CAST(NULL AS INTEGER)" if parent is None else f"CAST({nodes} + {parent} AS INTEGER)"
            rows.append(f"SELECT k AS doc_id, CAST({nodes} + {at} AS INTEGER) AS node_id, {above} AS parent_id, {_quoted(title)} AS title, '{kind}' AS type, {depth} AS depth, CAST({lines} + {line} AS INTEGER) AS line, {_metadata(meta)} AS metadata FROM ({_PARTS}) src WHERE {_included(i)}")
        content += f" || CASE WHEN {_included(i)} THEN {_lines(*map(_quoted, text))} || {NL} ELSE '' END"
        nodes += f" + CASE WHEN {_included(i)} THEN {len(found)} ELSE 0 END"
        lines += f" + CASE WHEN {_included(i)} THEN {len(text)} ELSE 0 END"
    return content, " UNION ALL ".join(rows)


for _ext, (_head, _snippets) in SAMPLES.items():
    _content, _nodes_sql = _sampled(_head, _snippets)
    _register(f"extract_{_ext}", _corpus(_ext, _content), lambda d: code.code_outline(d).select(*NODES, "metadata"), _nodes_sql)
_register("toml_symbols", _TOML, lambda d: api.symbols(d).select("doc_id", "name", "kind", "start_line", "exported"), " UNION ALL ".join(f"SELECT k AS doc_id, '{n}' AS name, 'variable' AS kind, {line} AS start_line, false AS exported FROM ({_PARTS}) src" for n, line in (("title", 1), ("a", 2), ("key", 3), ("a.b.c", 4), ("list", 5), ("d", 7), ("in", 8), ("x", 8), ("y", 8))))

_OVERLOADS = _corpus("cs", _lines(*map(_quoted, ("class C{k} {", "  int Add(int a) => a;", "  int Add(int a, int b) => a;", "  void Go() {}", "  int Add() => 1;", "}"))))
_register("overload_grouping", _OVERLOADS, lambda d: code.code_outline(d, grouped=True).select(*NODES, F.get_json_object("metadata", "$.overloads").cast("int").alias("overloads")), _expected([(None, "C{k}", "class", 1, 1, "CAST(NULL AS INTEGER)"), (0, "Add", "method", 2, 2, "3"), (0, "Go", "method", 2, 4, "NULL")], "overloads"))


def _values(columns: str, rows: list[tuple]) -> str:
    names = columns.split()
    return " UNION ALL ".join("SELECT k AS doc_id, " + ", ".join(f"{v} AS \"{c}\"" for v, c in zip(r, names)) + f" FROM ({_PARTS}) src" for r in rows)


_register("symbol_table", _CORPORA["ts"], lambda d: api.symbols(d).drop("seq"), _values("name qualified_name kind start_line end_line exported signature", [
    ("'C' || k", "'C' || k", "'class'", 2, 6, "true", "CAST(NULL AS VARCHAR)"), ("'v'", "'C' || k || '.v'", "'property'", 3, 3, "false", "NULL"), ("'run'", "'C' || k || '.run'", "'method'", 4, 4, "false", "'(a: number, b: string): string'"),
    ("'run2'", "'C' || k || '.run2'", "'property'", 5, 5, "false", "NULL"), ("'help'", "'help'", "'function'", 7, 7, "false", "'(x)'"), ("'f' || k", "'f' || k", "'function'", 8, 8, "true", "'(y)'")]))
_register("qualified_names", _CORPORA["java"], lambda d: code.definitions(d).select("doc_id", "qualified_name"), _values("qualified_name", [("'a.b'",), ("'c.d.E'",), *[(f"'C' || k || '{x}'",) for x in ("", ".x", ".run", ".K", ".K.A", ".K.B")], ("'C' || k || '.C' || k",)]))
_register("call_edges", _CORPORA["py"], lambda d: api.references(d).where("kind = 'calls'").drop("seq"), _values("from to kind line", [("'C' || k || '._run'", "'help'", "'calls'", 6), ("'help'", "'c'", "'calls'", 9)]))
_register("import_edges", _CORPORA["py"], lambda d: api.references(d).where("kind = 'imports'").drop("seq"), _values("from to kind line", [("'f' || k || '.py'", "'os'", "'imports'", 1), ("'f' || k || '.py'", "'a.b'", "'imports'", 2)]))
_register("script_edges", _CORPORA["ts"], lambda d: api.references(d).drop("seq"), _values("from to kind line", [("'f' || k || '.ts'", "'m' || k", "'imports'", 1), ("'C' || k || '.run'", "'help'", "'calls'", 4), ("'f' || k", "'help'", "'calls'", 8)]))


_REPEATED = _corpus("ts", _lines(*map(_quoted, ("function f{k}() {}", "f{k}(); f{k}();", "f{k}();"))))
_register("edge_dedupe", _REPEATED, lambda d: api.references(d).select("doc_id", "from", "to", "line"), _values("from to line", [("'f' || k || '.ts'", "'f' || k", 2), ("'f' || k || '.ts'", "'f' || k", 3)]))
_LANGUAGES = " UNION ALL ".join(f"SELECT '{e}' || doc_id AS doc_id, ext, file_name, content FROM ({_CORPORA[e]})" for e in ("ts", "py", "go", "java", "lua"))
_register("edges_by_language", _LANGUAGES, code.reference_counts, " UNION ALL ".join(f"SELECT '{e}' || k AS doc_id, '{e}' AS ext, CAST({n} AS BIGINT) AS n FROM ({_PARTS}) src" for e, n in (("ts", 3), ("py", 4), ("go", 0), ("java", 0), ("lua", 0))))


# Doc comments


def _doc(style: str, *lines: str) -> None:
    corpus = _corpus("txt", _lines(*map(_quoted, lines)))
    name = {"jsdoc": "doc_jsdoc", "javadoc": "doc_javadoc", "xmldoc": "doc_xmldoc"}.get(style) or style
    QUERIES[name] = lambda spark, sf_dir: _documents(spark, sf_dir, corpus).select("doc_id", parse_doc_json(F.lit(style if style in ("jsdoc", "javadoc", "xmldoc") else "pydoc"), F.col("content")).alias("doc"))


def _json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"))


def _doc_oracle(name: str, doc: dict) -> None:
    ORACLE_SQL[name] = f"SELECT k AS doc_id, {_quoted(_json(doc))} AS doc FROM ({_PARTS}) src"


_doc("jsdoc", "Makes part {k}.", "", "In two lines.", "@param {string} [name] - the {n}", "@param size", "more", "@returns {number} the key")
_doc_oracle("doc_jsdoc", dict(summary="Makes part {k}. In two lines.", params=[dict(name="name", type="string", description="the {n}"), dict(name="size")], returns=dict(type="number", description="the key")))
_doc("javadoc", "Makes <b>part</b> {@link P} {k}.", "@param name the <i>{n}</i>", "@return it")
_doc_oracle("doc_javadoc", dict(summary="Makes part P {k}.", params=[dict(name="name", description="the {n}")], returns=dict(description="it")))
_doc("xmldoc", "<summary>", "  Makes   part {k}.", "</summary>", '<param name="a">the {n}</param>', "<returns>it &amp; more</returns>")
_doc_oracle("doc_xmldoc", dict(summary="Makes part {k}.", params=[dict(name="a", description="the {n}")], returns=dict(description="it & more")))
_doc("doc_sphinx", "Makes part {k}.", "", ":param str name: the {n}", ":type size: int", ":param size: how big", ":returns: it", ":rtype: Part")
_doc_oracle("doc_sphinx", dict(summary="Makes part {k}.", params=[dict(name="name", type="str", description="the {n}"), dict(name="size", type="int", description="how big")], returns=dict(type="Part", description="it")))
_doc("doc_numpy", "Makes part {k}.", "", "Parameters", "----------", "name : str", "    the {n}", "    again", "", "Returns", "-------", "Part", "    it")
_doc_oracle("doc_numpy", dict(summary="Makes part {k}.", params=[dict(name="name", type="str", description="the {n} again")], returns=dict(type="Part", description="it")))
_doc("doc_google", "Makes part {k}.", "", "Args:", "    name (str): the {n}", "        again", "    *rest: others", "Raises:", "    E: never", "Returns:", "    Part: it")
_doc_oracle("doc_google", dict(summary="Makes part {k}.", params=[dict(name="name", type="str", description="the {n} again"), dict(name="*rest", description="others")], returns=dict(type="Part", description="it")))
_doc("doc_plain", "", "Makes part {k}", "of {n}.", "", "No more.")
_doc_oracle("doc_plain", dict(summary="Makes part {k} of {n}."))


def _commented(docs: DataFrame) -> DataFrame:
    meta = [F.get_json_object("metadata", f"$.{k}").alias(c) for k, c in (("docstring", "docstring"), ("doc.summary", "summary"), ("doc.params[0].name", "param"))]
    return code.code_outline(docs, include_comments=True).select("doc_id", "title", *meta)


def _documented(ext: str, lines: tuple[str, ...], rows: list[tuple]) -> None:
    """Which comment belongs to which definition, how it is cleaned, and by which style it is read."""
    def text(value: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if value is None else f" || {NL} || ".join(f"({_quoted(v)})" for v in value.split("\n"))

    _register(f"doc_attach_{ext}", _corpus(ext, _lines(*map(_quoted, lines))), _commented, " UNION ALL ".join(f"SELECT k AS doc_id, {text(r[0])} AS title, {text(r[1])} AS docstring, {text(r[2])} AS summary, {text(r[3])} AS param FROM ({_PARTS}) src" for r in rows))


_documented("ts", ("/**", " * Makes {k}.", " * @param {string} x the {n}", " */", "function a{k}(x) {}", "", "// loose", "", "function b{k}() {}", "// one", "// two", "export function c{k}() {}", "/* block", " * text */", "class D{k} {", "  // inner", "  go() {}", "}"), [("a{k}", "Makes {k}.\n@param {string} x the {n}", "Makes {k}.", "x"), ("b{k}", None, None, None), ("c{k}", "one\n two", "one two", None), ("D{k}", "block\ntext", "block text", None), ("go", "inner", "inner", None)])
_documented("py", ("def a{k}(x):", '    """Makes {k}.', "", "    Args:", '        x: the {n}"""', "", "# loose", "def b{k}(): pass"), [("a{k}", "Makes {k}.\n\n    Args:\n        x: the {n}", "Makes {k}.", "x"), ("b{k}", None, None, None)])
_documented("java", ("class A{k} {", "  /** Makes <b>{k}</b>.", "   * @param x the {n} */", "  void go(int x) {}", "}"), [("A{k}", None, None, None), ("go", "Makes <b>{k}</b>.\n@param x the {n}", "Makes {k}.", "x")])
_documented("cs", ("/// <summary>Makes {k}.</summary>", '/// <param name="x">the {n}</param>', "class A{k} {}"), [("A{k}", '<summary>Makes {k}.</summary>\n <param name="x">the {n}</param>', "Makes {k}.", "x")])


# Formats

_TREE = _corpus("md", _lines(*map(_quoted, ('# "{k}"', "## Size", "### It''s <{k}>", "# End"))).replace("''''", "''"))
_CLASS = _corpus("ts", _lines(*map(_quoted, ("class C{k} {", "  private a: number;", "  run(x, y) {}", "}"))))


def _format(name: str, fmt: str, text: str, corpus: str = _TREE, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: sinks.format_outline(_nodes(_documents(spark, sf_dir, corpus), "md" if corpus is _TREE else "ts"), fmt, **options)
    ORACLE_SQL[name] = f"SELECT k AS doc_id, {_quoted(text)} AS output FROM ({_PARTS}) src"


def _nodes(docs: DataFrame, ext: str) -> DataFrame:
    return api.outline(docs, include_line_numbers=True, only=[ext])  # a union would forget how documents are spread


_format("fmt_ascii_tree", "ascii-tree", '├─ "{k}" [heading] (line 1)\n  ├─ Size [heading] (line 2)\n    ├─ It\'s <{k}> [heading] (line 3)\n├─ End [heading] (line 4)\n')
_format("fmt_ascii_compact", "tree", '├─ "{k}" [heading]\n  ├─ Size [heading]\n    ├─ It\'s <{k}> [heading]\n├─ End [heading]\n', compact=True)
_format("fmt_csv", "csv", 'path,title,type,depth,line\n"""{k}""","""{k}""",heading,1,1\n"""{k}""/Size",Size,heading,2,2\n"""{k}""/Size/It\'s <{k}>",It\'s <{k}>,heading,3,3\nEnd,End,heading,1,4\n')
_format("fmt_dot", "dot", 'digraph outline {\n  rankdir=LR;\n  node [shape=box];\n  n0 [label="\\"{k}\\"\\n[heading]"];\n  n1 [label="Size\\n[heading]"];\n  n2 [label="It\'s <{k}>\\n[heading]"];\n  n3 [label="End\\n[heading]"];\n  n0 -> n1;\n  n1 -> n2;\n}\n')
_SQL_HEAD = "CREATE TABLE outline_nodes (\n  id INTEGER PRIMARY KEY,\n  parent_id INTEGER,\n  title TEXT,\n  type TEXT,\n  depth INTEGER,\n  line INTEGER\n);\n\n"
_format("fmt_sql", "sql", _SQL_HEAD + "".join(f"INSERT INTO outline_nodes (id, parent_id, title, type, depth, line) VALUES ({i}, {p}, '{t}', 'heading', {d}, {i + 1});\n" for i, (p, t, d) in enumerate((("NULL", '"{k}"', 1), (0, "Size", 2), (1, "It''s <{k}>", 3), ("NULL", "End", 1)))))
_format("fmt_mermaid", "mermaid", 'flowchart TD\n  n0["\'{k}\'"]\n  n1["Size"]\n  n2["It\'s <{k}>"]\n  n3["End"]\n  n0 --> n1\n  n1 --> n2\n')
_format("fmt_mermaid_class", "mermaid", 'classDiagram\n  class C{k}["C{k}"] {\n    -a\n    +run(x, y)\n  }\n', _CLASS)
_format("fmt_plantuml", "plantuml", '@startmindmap\n* "{k}"\n** Size\n*** It\'s <{k}>\n* End\n@endmindmap\n')
_format("fmt_plantuml_class", "plantuml", '@startuml\nclass "C{k}" as C{k} {\n  -a\n  +run(x, y)\n}\n@enduml\n', _CLASS)
_format("fmt_json", "json", _json([dict(title="C{k}", type="class", depth=1, line=1, children=[dict(title="a", type="property", depth=2, line=2, metadata=dict(visibility="private", dataType="number")), dict(title="run", type="method", depth=2, line=3, metadata=dict(parameters=[dict(name="x"), dict(name="y")]))])]), _CLASS, compact=True)
_format("fmt_yaml", "yaml", "- title: C{k}\n  type: class\n  depth: 1\n  line: 1\n  children:\n    - title: a\n      type: property\n      depth: 2\n      line: 2\n      metadata:\n        visibility: private\n        dataType: number\n    - title: run\n      type: method\n      depth: 2\n      line: 3\n      metadata:\n        parameters:\n          - name: x\n          - name: 'y'\n", _CLASS)
_format("fmt_xml", "xml", '<?xml version="1.0" encoding="UTF-8"?>\n<outline>\n  <node title="C{k}" type="class" depth="1" line="1">\n    <node title="a" type="property" depth="2" line="2">\n      <metadata>\n        <entry key="visibility" value="private"/>\n        <entry key="dataType" value="number"/>\n      </metadata>\n    </node>\n    <node title="run" type="method" depth="2" line="3">\n      <metadata>\n        <entry key="parameters" value="[{&quot;name&quot;:&quot;x&quot;},{&quot;name&quot;:&quot;y&quot;}]"/>\n      </metadata>\n    </node>\n  </node>\n</outline>\n', _CLASS)


def _item(depth: int, title: str, line: int, anchor: str) -> str:
    return "  " * (2 * depth - 1) + f'<li id="{anchor}">{title} <span class="type">[heading]</span> <span class="line">(line {line})</span>\n'


_PAGE = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="UTF-8">
<title>Outline</title>
<style>
  ul { list-style: none; margin: 0.1rem 0; padding-left: 1.2rem; }
  .type { color: #777; }
  .line { color: #aaa; }
</style>
</head>
<body>
<h1>Outline</h1>
<ul>
"""
_format("fmt_html", "html", _PAGE + _item(1, "&quot;{k}&quot;", 1, "{k}") + "    <ul>\n" + _item(2, "Size", 2, "size") + "        <ul>\n" + _item(3, "It&apos;s &lt;{k}&gt;", 3, "its-{k}") + "          </li>\n        </ul>\n      </li>\n    </ul>\n  </li>\n" + _item(1, "End", 4, "end") + "  </li>\n</ul>\n</body>\n</html>\n")


# Registries and constants, and files


def _listed(names: Callable[[], list[str]]) -> Query:
    return lambda spark, sf_dir: spark.createDataFrame(list(enumerate(names())), "at int, name string")


def _list_oracle(names: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS at, '{n}' AS name" for i, n in enumerate(names.split()))


QUERIES["extension_registry"] = _listed(lambda: sorted(api.extensions()))
ORACLE_SQL["extension_registry"] = _list_oracle("adoc asciidoc cfg conf cpp cs csv env gemspec go htm html ini java js json jsx kt kts latex lua markdown md mediawiki org php phtml properties py rake rb rest rs rst sbt scala swift tex toml ts tsx wiki xml yaml yml")
QUERIES["format_registry"] = _listed(sinks.formats)
ORACLE_SQL["format_registry"] = _list_oracle("ascii-tree csv dot html json mermaid plantuml sql tree xml yaml")
QUERIES["symbol_kinds"] = _listed(lambda: sorted(schema.symbol_table_schema()["properties"]["symbols"]["items"]["properties"]["kind"]["enum"]))
ORACLE_SQL["symbol_kinds"] = _list_oracle("class constant constructor enum enum_member field function interface method module namespace property struct trait type_alias variable")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several extensions in nested folders, found again by a recursive scan of some."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
    root = f"{base.rstrip('/')}/tessella-files-{uuid.uuid4().hex[:12]}"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("# "), "n_name").alias("value"))
    rows.write.partitionBy("k").text(f"{root}/a")
    rows.write.partitionBy("k").option("header", False).csv(f"{root}/b")
    found = read_documents(spark, root, recursive=True, extensions=["txt"])
    return found.select(F.regexp_extract("path", "/a/k=([0-9]+)/", 1).alias("k"), "ext", "content")


QUERIES["file_scan"] = _scanned
ORACLE_SQL["file_scan"] = f"SELECT CAST(n_nationkey AS VARCHAR) AS k, 'txt' AS ext, '# ' || n_name || {NL} AS content FROM nation"


# Trees, hashes and corpus summaries

_register("tree_paths", _MD, lambda d: with_paths(markup.markdown(d)).select("doc_id", "node_id", "tree_depth", F.array_join("path", "/").alias("path")), """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS n, p_partkey % 3 = 0 AS deep FROM part)
    SELECT k AS doc_id, 0 AS node_id, 1 AS tree_depth, n AS path FROM p UNION ALL SELECT k, 1, 2, n || '/Size' FROM p UNION ALL SELECT k, 2, 3, n || '/Size/Deep' FROM p WHERE deep
    UNION ALL SELECT k, CASE WHEN deep THEN 3 ELSE 2 END, 3, n || '/Size/Part ' || k FROM p UNION ALL SELECT k, CASE WHEN deep THEN 4 ELSE 3 END, 2, n || '/End' FROM p""")
_DOCS = "SELECT CAST(doc_id AS STRING) AS doc_id, text AS content FROM documents"
_register("content_hash", _DOCS, lambda d: d.select("doc_id", content_hash(F.col("content")).alias("content_hash")), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS content_hash FROM documents")


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, _DOCS)
    old = docs.where("cast(doc_id as bigint) % 3 <> 0").withColumn("content", F.when(F.expr("cast(doc_id as bigint) % 5 = 0"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changed(docs, old.select("doc_id", content_hash(F.col("content")).alias("content_hash"))).select("doc_id", "content_hash")


QUERIES["incremental_antijoin"] = _incremental
ORACLE_SQL["incremental_antijoin"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"


def _type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = " UNION ALL ".join(f"SELECT '{e}' || doc_id AS doc_id, ext, file_name, content FROM ({c})" for e, c in (("m", _MD), ("i", _INI), ("t", _CORPORA["ts"]), ("p", _CORPORA["py"])))
    docs = _documents(spark, sf_dir, corpus)
    # an outline for each extension, so its nodes need no join to tell it
    nodes = [api.outline(docs, only=[e]).select(F.lit(e).alias("ext"), "type") for e in ("md", "ini", "ts", "py")]
    return reduce(DataFrame.unionByName, nodes).groupBy("ext", "type").agg(F.count("*").alias("n"))


QUERIES["corpus_type_counts"] = _type_counts
ORACLE_SQL["corpus_type_counts"] = "SELECT t.ext, t.type, CASE WHEN t.ext = 'md' THEN (SELECT 4 * count(*) + count(*) FILTER (p_partkey % 3 = 0) FROM part) ELSE t.k * (SELECT count(*) FROM part) END AS n FROM (VALUES ('md', 'heading', 4), ('ini', 'property', 4), ('ini', 'section', 2), ('ts', 'class', 1), ('ts', 'property', 2), ('ts', 'method', 1), ('ts', 'function', 2), ('py', 'class', 1), ('py', 'property', 1), ('py', 'method', 1), ('py', 'function', 2)) t(ext, type, k)"
