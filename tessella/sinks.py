"""Outlines as text: (doc_id, output) for each document, in ten formats.

A node's line is an expression of its row, and what closes after it of the next row's depth; so
nearly all formats are one grouped concatenation.  Only JSON and YAML, which indent nested values,
build the tree in Python, in Arrow batches of whole documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import UnsupportedFormatError
from tessella.functions.text import escape_csv, escape_sql, escape_xml, sanitize_id
from tessella.operators.tree import path_rows

CLASS_TYPES = tuple("class enum interface object struct trait type union".split())
MEMBER_TYPES = tuple("constructor destructor enum-value field function interface-method interface-property method operator property".split())
METHOD_TYPES = tuple("constructor function interface-method method".split())


def _pad(n: Column) -> Column:
    return F.repeat(F.lit("  "), n.cast("int"))


def _meta(key: str) -> Column:
    return F.get_json_object("metadata", f"$.{key}")


def _joined(rows: DataFrame, *texts: str, sep: str = "") -> DataFrame:
    """(doc_id, a column for each of ``texts``): the rows' texts in node order; null ones are skipped."""
    group = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", *texts))).alias("r"))
    return group.select("doc_id", *[F.array_join(F.filter(F.col(f"r.{t}"), lambda x: x.isNotNull()), sep).alias(t) for t in texts])


def _output(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select("doc_id", text.alias("output"))


def _parameter_names() -> Column:
    return F.coalesce(F.transform(F.from_json(_meta("parameters"), "array<struct<name:string>>"), lambda p: p["name"]), F.array().cast("array<string>"))


def ascii_tree(nodes: DataFrame, compact: bool = False) -> DataFrame:
    names = _parameter_names()
    parts = F.filter(F.array(F.when(_meta("visibility") != "public", _meta("visibility")), F.when(_meta("isStatic") == "true", "static"), F.when(_meta("isAbstract") == "true", "abstract"), F.when(F.size(names) > 0, F.concat(F.lit("params: "), F.array_join(names, ", "))), F.concat(F.lit("type: "), F.nullif(_meta("dataType"), F.lit("")))), lambda p: p.isNotNull())
    line = F.lit("") if compact else F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise("")
    meta = F.lit("") if compact else F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")
    text = F.concat(_pad(F.col("tree_depth") - 1), F.lit("├─ "), F.col("title"), F.lit(" ["), F.col("type"), F.lit("]"), line, meta, F.lit("\n"))
    return _output(_joined(nodes.select("doc_id", "node_id", text.alias("t")), "t"), F.col("t"))


def _csv_row(node: Column) -> Column:
    own = node["own"]
    return F.concat_ws(",", escape_csv(F.array_join(node["path"], "/")), escape_csv(own["title"]), escape_csv(own["type"]), own["tree_depth"].cast("string"), F.coalesce(own["line"].cast("string"), F.lit("")))


_CSV_COLUMNS = ("title", "type", "tree_depth", "line")


def csv_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, row) of the CSV format, for writing a corpus as rows."""
    rows = path_rows(nodes, *_CSV_COLUMNS).select("doc_id", F.explode("all").alias("p"))
    return rows.select("doc_id", F.col("p.node_id").alias("node_id"), _csv_row(F.col("p")).alias("row"))


def csv(nodes: DataFrame) -> DataFrame:
    rows = F.array_join(F.transform("all", _csv_row), "\n")
    return path_rows(nodes, *_CSV_COLUMNS).select("doc_id", F.concat(F.lit("path,title,type,depth,line\n"), rows, F.lit("\n")).alias("output"))


_SQL_COLUMNS = dict(id="INTEGER PRIMARY KEY", parent_id="INTEGER") | dict.fromkeys(("title", "type"), "TEXT") | dict.fromkeys(("depth", "line"), "INTEGER")
_SQL_TABLE = "CREATE TABLE outline_nodes (\n" + ",\n".join(f"  {name} {kind}" for name, kind in _SQL_COLUMNS.items()) + "\n);\n\n"
_SQL_INSERT = f"INSERT INTO outline_nodes ({', '.join(_SQL_COLUMNS)}) VALUES ("


def sql_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, row): the insert statement of each node."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    quoted = lambda c: F.concat(F.lit("'"), escape_sql(F.col(c)), F.lit("'"))
    values = F.concat_ws(", ", number("node_id"), number("parent_id"), quoted("title"), quoted("type"), number("tree_depth"), number("line"))
    return nodes.select("doc_id", "node_id", F.concat(F.lit(_SQL_INSERT), values, F.lit(");")).alias("row"))


def sql(nodes: DataFrame) -> DataFrame:
    return _output(_joined(sql_rows(nodes), "row", sep="\n"), F.concat(F.lit(_SQL_TABLE), F.col("row"), F.lit("\n")))


def _edge(arrow: str, end: str) -> Column:
    return F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("  n"), F.col("parent_id").cast("string"), F.lit(arrow), F.col("node_id").cast("string"), F.lit(end)))


def dot(nodes: DataFrame) -> DataFrame:
    label = F.replace(F.replace(F.concat(F.col("title"), F.lit("\\n["), F.col("type"), F.lit("]")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    rows = nodes.select("doc_id", "node_id", F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit(' [label="'), label, F.lit('"];\n')).alias("t"), _edge(" -> n", ";\n").alias("e"))
    return _output(_joined(rows, "t", "e"), F.concat(F.lit("digraph outline {\n  rankdir=LR;\n  node [shape=box];\n"), F.col("t"), F.col("e"), F.lit("}\n")))


def class_model(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, members, nested) of each class-like node: its members as
    (visibility, name, is_method, params) and the names of class-like children, in order."""
    mark = F.when(_meta("visibility") == "private", "-").when(_meta("visibility") == "protected", "#").when(_meta("visibility").isin("package", "internal"), "~").otherwise("+")
    children = nodes.where(F.col("type").isin(*CLASS_TYPES, *MEMBER_TYPES) & F.col("parent_id").isNotNull()).select("doc_id", F.col("parent_id").alias("class_id"), F.struct("node_id", F.col("title").alias("name"), mark.alias("visibility"), F.col("type").isin(*METHOD_TYPES).alias("is_method"), _parameter_names().alias("params"), F.col("type").isin(*CLASS_TYPES).alias("is_class")).alias("c"))
    grouped = children.groupBy("doc_id", "class_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    classes = nodes.where(F.col("type").isin(*CLASS_TYPES)).select("doc_id", "node_id", F.col("title").alias("name"))
    joined = classes.join(grouped.withColumnRenamed("class_id", "node_id"), ["doc_id", "node_id"], "left")
    all_ = F.coalesce("c", F.array().cast(grouped.schema["c"].dataType))
    return joined.select("doc_id", "node_id", "name", F.filter(all_, lambda c: ~c["is_class"]).alias("members"), F.transform(F.filter(all_, lambda c: c["is_class"]), lambda c: c["name"]).alias("nested"))


def _class_text(classes: DataFrame, head: Column, pad: str, foot: str, arrow_pad: str) -> DataFrame:
    own = sanitize_id(F.col("name"))
    member = lambda c: F.concat(F.lit(pad), c["visibility"], c["name"], F.when(c["is_method"], F.concat(F.lit("("), F.array_join(c["params"], ", "), F.lit(")"))).otherwise(""), F.lit("\n"))
    arrow = lambda n: F.concat(F.lit(arrow_pad), own, F.lit(" *-- "), sanitize_id(n), F.lit("\n"))
    text = F.concat(head, F.array_join(F.transform("members", member), ""), F.lit(foot), F.array_join(F.transform("nested", arrow), ""))
    return _joined(classes.select("doc_id", "node_id", text.alias("t")), "t")


def _either(nodes: DataFrame, classes: DataFrame, plain: DataFrame) -> DataFrame:
    """The class diagram of documents that have a class, the plain one of the others."""
    return plain.join(classes.withColumnRenamed("output", "own"), "doc_id", "left").select("doc_id", F.coalesce("own", "output").alias("output"))


def mermaid(nodes: DataFrame) -> DataFrame:
    classes = class_model(nodes)
    head = F.concat(F.lit("  class "), sanitize_id(F.col("name")), F.lit('["'), F.col("name"), F.lit('"] {\n'))
    diagrams = _output(_class_text(classes, head, "    ", "  }\n", "  "), F.concat(F.lit("classDiagram\n"), F.col("t")))
    rows = nodes.select("doc_id", "node_id", F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit('["'), F.replace("title", F.lit('"'), F.lit("'")), F.lit('"]\n')).alias("t"), _edge(" --> n", "\n").alias("e"))
    return _either(nodes, diagrams, _output(_joined(rows, "t", "e"), F.concat(F.lit("flowchart TD\n"), F.col("t"), F.col("e"))))


def plantuml(nodes: DataFrame) -> DataFrame:
    classes = class_model(nodes)
    head = F.concat(F.lit('class "'), F.col("name"), F.lit('" as '), sanitize_id(F.col("name")), F.lit(" {\n"))
    diagrams = _output(_class_text(classes, head, "  ", "}\n", ""), F.concat(F.lit("@startuml\n"), F.col("t"), F.lit("@enduml\n")))
    rows = nodes.select("doc_id", "node_id", F.concat(F.repeat(F.lit("*"), F.col("tree_depth")), F.lit(" "), F.col("title"), F.lit("\n")).alias("t"))
    return _either(nodes, diagrams, _output(_joined(rows, "t"), F.concat(F.lit("@startmindmap\n"), F.col("t"), F.lit("@endmindmap\n"))))


def _with_next(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``next_depth``, the tree depth of what follows (1 at the end), and ``leaf``."""
    after = F.lead("tree_depth").over(Window.partitionBy("doc_id").orderBy("node_id"))
    return nodes.withColumn("next_depth", F.coalesce(after, F.lit(1))).withColumn("leaf", F.col("next_depth") <= F.col("tree_depth"))


def _closed(text: Callable[[Column], Column]) -> Column:
    """``text`` of each ancestor's depth that ends after this node, from the inside out."""
    last, first = F.col("tree_depth") - 1, F.col("next_depth")
    return F.when(F.col("leaf") & (last >= first), F.array_join(F.transform(F.reverse(F.sequence(first, F.greatest(first, last))), text), "")).otherwise("")


_XML_DECLARED = 'version="1.0" encoding="UTF-8"'
_XML_HEAD = f"<?xml {_XML_DECLARED}?>\n<outline>\n"


def xml(nodes: DataFrame) -> DataFrame:
    rows = _with_next(nodes)
    depth = F.col("tree_depth")
    attributes = F.concat(F.lit('<node title="'), escape_xml(F.col("title")), F.lit('" type="'), escape_xml(F.col("type")), F.lit('" depth="'), F.col("depth").cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' line="'), F.col("line").cast("string"), F.lit('"')), F.lit("")))
    entries = F.map_entries(F.from_json("metadata", "map<string,string>"))
    entry = lambda e: F.concat(_pad(depth + 2), F.lit('<entry key="'), escape_xml(e["key"]), F.lit('" value="'), escape_xml(e["value"]), F.lit('"/>\n'))
    meta = F.when(F.size(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))) > 0, F.concat(_pad(depth + 1), F.lit("<metadata>\n"), F.array_join(F.transform(entries, entry), ""), _pad(depth + 1), F.lit("</metadata>\n")))
    end = lambda d: F.concat(_pad(d), F.lit("</node>\n"))
    text = F.when(F.col("leaf") & meta.isNull(), F.concat(_pad(depth), attributes, F.lit("/>\n"))).otherwise(F.concat(_pad(depth), attributes, F.lit(">\n"), F.coalesce(meta, F.lit("")), F.when(F.col("leaf"), end(depth)).otherwise("")))
    joined = _joined(rows.select("doc_id", "node_id", F.concat(text, _closed(end)).alias("t")), "t")
    return _output(joined, F.concat(F.lit(_XML_HEAD), F.col("t"), F.lit("</outline>\n")))


_HTML_HEAD = "".join(f"<{tag}>\n" for tag in ("!DOCTYPE html", 'html lang="en"', "head", 'meta charset="UTF-8"', "title>Outline</title", "style"))
_HTML_HEAD += "".join(f"  {rule}\n" for rule in ("ul { list-style: none; margin: 0.1rem 0; padding-left: 1.2rem; }", ".type { color: #777; }", ".line { color: #aaa; }"))
_HTML_HEAD += "".join(f"<{tag}>\n" for tag in ("/style", "/head", "body", "h1>Outline</h1", "ul"))
_HTML_FOOT = "</ul>\n</body>\n</html>\n"


def html(nodes: DataFrame) -> DataFrame:
    depth = F.col("tree_depth")
    item = F.concat(_pad(2 * depth - 1), F.lit("<li"), F.coalesce(F.concat(F.lit(' id="'), escape_xml(F.nullif("anchor", F.lit(""))), F.lit('"')), F.lit("")), F.lit(">"), escape_xml(F.col("title")), F.lit(' <span class="type">['), escape_xml(F.col("type")), F.lit("]</span>"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(' <span class="line">(line '), F.col("line").cast("string"), F.lit(")</span>"))).otherwise(""), F.lit("\n"))
    after = F.when(F.col("leaf"), F.concat(_pad(2 * depth - 1), F.lit("</li>\n"))).otherwise(F.concat(_pad(2 * depth), F.lit("<ul>\n")))
    end = lambda d: F.concat(_pad(2 * d), F.lit("</ul>\n"), _pad(2 * d - 1), F.lit("</li>\n"))
    joined = _joined(_with_next(nodes).select("doc_id", "node_id", F.concat(item, after, _closed(end)).alias("t")), "t")
    return _output(joined, F.concat(F.lit(_HTML_HEAD), F.col("t"), F.lit(_HTML_FOOT)))


def _tree(rows) -> list[dict]:
    """Nested nodes without empty parts, of one document's rows in pre-order."""
    roots: list[dict] = []
    by_id: dict[int, dict] = {}
    for r in rows:
        node = {"title": r["title"], "type": r["type"], "depth": int(r["depth"])}
        if r["line"] is not None:
            node["line"] = int(r["line"])
        if r["metadata"] and r["metadata"] != "{}":
            node["metadata"] = json.loads(r["metadata"])
        by_id[r["node_id"]] = node
        (roots if r["parent_id"] is None else by_id[r["parent_id"]].setdefault("children", [])).append(node)
    return roots


def _nested(nodes: DataFrame, dump: Callable[[list[dict]], str]) -> DataFrame:
    def dumped(documents: pd.Series) -> pd.Series:
        return documents.map(lambda rows: dump(_tree(rows)))

    group = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "title", "type", "depth", "line", "metadata"))).alias("rows"))
    return group.select("doc_id", F.pandas_udf(dumped, "string")("rows").alias("output"))


def _dump_json(compact: bool):
    def dump(tree):
        return json.dumps(tree, ensure_ascii=False, indent=None if compact else 2, separators=(",", ":") if compact else (",", ": "))

    return dump


@lru_cache(maxsize=1)
def _yaml_dumper():
    import yaml

    class Dumper(yaml.SafeDumper):
        """Lists indented, no references, and the one-letter booleans of old quoted."""

        def ignore_aliases(self, data):
            return True

        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    Dumper.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^[yYnN]$"), list("yYnN"))
    return Dumper


#: Strings of one line that YAML writes as they are, if they mean nothing else.
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:[ ./(){}<>=+*$-]*[A-Za-z0-9_(){}<>=+*$])*")
_ONE_LINE = re.compile(r"[\x20-\x7e]{1,100}")
_WORDS = frozenset("y yes n no true false on off null".split())


@lru_cache(maxsize=1 << 16)
def _yaml_text(text: str) -> str:
    """A string of one line as the dumper writes it; the dumper itself is slow."""
    import yaml

    if text.lower() not in _WORDS and _PLAIN.fullmatch(text):
        return text
    return yaml.dump([text], Dumper=_yaml_dumper(), allow_unicode=True, width=float("inf"))[2:-1]


def _yaml_lines(value: object, pad: str, out: list[str]) -> None:
    """The lines of a mapping or list that isn't empty; ValueError for what the dumper must write."""
    pairs = [("- ", v) for v in value] if isinstance(value, list) else [(_yaml_key(k), v) for k, v in value.items()]
    for head, v in pairs:
        if isinstance(v, (dict, list)) and v:
            if head != "- ":
                out.append(f"{pad}{head}")
                _yaml_lines(v, pad + "  ", out)
                continue
            first = len(out)
            _yaml_lines(v, pad + "  ", out)
            out[first] = f"{pad}- {out[first][len(pad) + 2 :]}"
            continue
        if isinstance(v, str):
            if not _ONE_LINE.fullmatch(v):
                raise ValueError
            text = _yaml_text(v)
        elif v is None or isinstance(v, (bool, int)):
            text = "null" if v is None else str(v).lower()
        elif v == [] or v == {}:
            text = "[]" if isinstance(v, list) else "{}"
        else:
            raise ValueError
        out.append(f"{pad}{head}{text}" if head == "- " else f"{pad}{head} {text}")


def _yaml_key(key: str) -> str:
    if not _ONE_LINE.fullmatch(key):
        raise ValueError
    return f"{_yaml_text(key)}:"


def _dump_yaml(tree):
    import yaml

    try:
        out: list[str] = []
        _yaml_lines(tree, "", out)
        if out:
            return "\n".join(out) + "\n"
    except ValueError:
        pass
    return yaml.dump(tree, Dumper=_yaml_dumper(), sort_keys=False, allow_unicode=True, width=float("inf"))


def json_tree(nodes: DataFrame, compact: bool = False) -> DataFrame:
    return _nested(nodes, _dump_json(compact))


def yaml_tree(nodes: DataFrame) -> DataFrame:
    return _nested(nodes, _dump_yaml)


#: What documents without nodes give.
_EMPTY = {"ascii-tree": "", "tree": "", "json": "[]", "yaml": "[]\n", "xml": _XML_HEAD + "</outline>\n", "csv": "path,title,type,depth,line\n", "sql": _SQL_TABLE, "dot": "digraph outline {\n  rankdir=LR;\n  node [shape=box];\n}\n", "mermaid": "flowchart TD\n", "plantuml": "@startmindmap\n@endmindmap\n", "html": _HTML_HEAD + _HTML_FOOT}
_FORMATS: dict[str, Callable[..., DataFrame]] = {"ascii-tree": ascii_tree, "tree": ascii_tree, "json": json_tree, "yaml": yaml_tree, "xml": xml, "csv": csv, "sql": sql, "dot": dot, "mermaid": mermaid, "plantuml": plantuml, "html": html}


def formats() -> list[str]:
    """Names of all formats, aliases included, sorted."""
    return sorted(_FORMATS)


def register_format(name: str, formatter: Callable[..., DataFrame]) -> None:
    """Add or replace a format: a function from nodes to (doc_id, output)."""
    _FORMATS[name.lower()] = formatter


def format_outline(nodes: DataFrame, name: str, docs: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, output) in the named format; with ``docs``, of documents without nodes too."""
    formatter = _FORMATS.get(name.lower())
    if formatter is None:
        raise UnsupportedFormatError(name, formats())
    out = formatter(nodes, **options)
    if docs is None:
        return out
    return docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("output", F.lit(_EMPTY.get(name.lower(), ""))).alias("output"))
