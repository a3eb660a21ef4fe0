"""Outlines, symbols and references of source code.

One Python call for each document, in Arrow batches, does what lies within it: parsing, nesting,
overloads, qualified names, resolution of names and edges.  So nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.docstrings import doc_style, parse_doc_json
from tessella.functions.text import generate_id
from tessella.plans.code.languages import BY_EXTENSION
from tessella.plans.code.scanner import Definition, Scanner
from tessella.plans.code.worded import lua_definitions, python_definitions, ruby_definitions
from tessella.plans.nested import Node, dump, parse_toml
from tessella.schema import NODE_COLUMNS

PYTHON, RUBY, LUA = ("py",), ("rb", "rake", "gemspec"), ("lua",)
EXTENSIONS = (*BY_EXTENSION, *PYTHON, *RUBY, *LUA)
SCRIPTS = ("ts", "tsx", "js", "jsx")
#: Capture kinds inside of which a function is a method.
CLASS_LIKE = {"rs": ("impl", "trait"), "php": ("class", "interface", "trait"), "phtml": ("class", "interface", "trait"), "kt": ("class", "interface", "object"), "kts": ("class", "interface", "object"), "swift": ("class", "protocol"), "scala": ("class", "object", "trait"), "sbt": ("class", "object", "trait"), **dict.fromkeys(RUBY, ("class", "module")), "lua": ()}
#: Symbol kinds by capture kind; those not here are variables.
SYMBOL_KIND = {k: k for k in "class constant constructor enum field function interface method module namespace property struct trait variable".split()} | {"const": "constant", "enum-member": "enum_member", "enum-value": "enum_member", "impl": "class", "interface-method": "method", "interface-property": "property", "mod": "module", "object": "class", "package": "module", "type": "type_alias", "typedef": "type_alias", "union": "struct"}

_DEFINITIONS = "doc_id string, ext string, def_id int, parent_id int, start int, end int, kind string, type string, name string, tree_depth int, line int, col int, end_line int, end_col int, exported boolean, docstring string, metadata string, qualified_name string, parent_kind string, overloads int"
_KINDS = [pa.string(), pa.string(), *[pa.int32()] * 4, *[pa.string()] * 3, *[pa.int32()] * 5, pa.bool_(), *[pa.string()] * 4, pa.int32()]
_EDGES = "doc_id string, seq int, from string, to string, kind string, line int"
_WORDS = frozenset("if for while switch catch return function typeof new await super import constructor with do else in of instanceof void delete yield throw case".split())
_CALL = re.compile(r"(?<![\w$])(?P<new>new\s+(?:[\w$]+\s*\.\s*)*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>()=;]*>\s*)?(?:\?\.\s*)?\(")
_IMPORT = re.compile(r"\bimport\b(?!\s*[(.])(?:[^;'\"]*?\bfrom\b)?\s*(['\"])")


def read(text: str, ext: str, references: bool = True) -> tuple[Scanner, list[Definition], list[tuple[int, str, str]]]:
    """A file's definitions in source order and, if wanted, its references (offset, kind, name)."""
    if ext in PYTHON:
        return python_definitions(text, references)
    if ext in RUBY:
        return *ruby_definitions(text), []
    if ext in LUA:
        return *lua_definitions(text), []
    s = Scanner(text, BY_EXTENSION[ext])
    defs = s.scan()
    for d in defs:
        d.docstring = s.doc(d)
    return s, defs, _script_references(s, defs) if references and ext in SCRIPTS else []


def _script_references(s: Scanner, defs: list[Definition]) -> list[tuple[int, str, str]]:
    named = {d.name_at for d in defs}
    shut = [(d.start, d.end) for d in defs if d.kind in ("interface", "type")]
    bodies = [d for d in defs if d.kind == "class"]
    out = []
    for m in _CALL.finditer(s.mask):
        at = m.start("name")
        if m["new"] or m["name"] in _WORDS and s.mask[at - 1 : at] != "." or at in named or any(a <= at < b for a, b in shut):
            continue
        before = s.mask[max(0, at - 40) : at].rstrip()
        if re.search(r"(?:\bfunction|\bfunction\s*\*)$", before):
            continue
        if s.mask[at - 1 : at] != "." and any(d.start < at < d.end and _member_head(s, d, m.end() - 1) for d in bodies):
            continue
        out.append((at, "calls", m["name"]))
    for m in _IMPORT.finditer(s.mask):
        quote = m.end() - 1
        end = s.mask.find(m[1], quote + 1)
        if end > quote and (m.start() == 0 or s.mask[: m.start()].rstrip()[-1:] in ("", ";", "}", "'", '"', ")") or s.mask[: m.start()].rstrip(" \t")[-1:] == "\n"):
            out.append((quote + 1, "imports", s.text[quote + 1 : end]))
    return sorted(out)


def _member_head(s: Scanner, owner: Definition, paren: int) -> bool:
    """Whether brackets belong to a signature right in a class's body."""
    close = s.close(paren)
    opener = s.mask.find("{", owner.start)
    depth = 0
    at = opener + 1
    while 0 < at < paren:
        c = s.mask[at]
        if c in "({[":
            if s.close(at) > paren:
                depth += 1
            else:
                at = s.close(at)
        at += 1
    follows = s.mask[close + 1 :].lstrip()[:1]
    line = s.mask[s.mask.rfind("\n", 0, paren) + 1 : paren]
    return depth == 0 and follows in ("{", ":", ";") and "=" not in line and "." not in line


def _batch(rows: list[tuple], kinds: list[pa.DataType], ddl: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _named(depths: list[int], names: list[str], kinds: list[str]) -> list[tuple[str, str | None]]:
    """For definitions in pre-order, the names from the outermost one inwards and the kind of what
    is around each."""
    out, path, above = [], [], []
    for depth, name, kind in zip(depths, names, kinds):
        del path[depth - 1 :], above[depth - 1 :]
        path.append(name)
        out.append((".".join(path), above[depth - 2] if 0 <= depth - 2 < len(above) else None))
        above.append(kind)
    return out


def _depths(defs: list[Definition]) -> list[int]:
    depths: list[int] = []
    for d in defs:
        depths.append(1 if d.parent is None else depths[d.parent] + 1)
    return depths


def _mapped_definitions(grouped: bool, max_depth: int | None, batches):
    for batch in batches:
        rows = []
        for doc_id, ext, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ext", "content"))):
            s, defs, _ = read(content or "", ext, False)
            depths = _depths(defs)
            named = _named(depths, [d.name for d in defs], [d.kind for d in defs])
            counts = _overloads(defs, depths) if grouped else dict.fromkeys(range(len(defs)), 1)
            new: dict[int, int] = {}
            for i, n in counts.items():
                d = defs[i]
                if max_depth and depths[i] > max_depth:
                    continue
                new[i] = len(new)
                exported = d.exported or d.meta.get("visibility") == "public"
                rows.append((doc_id, ext, new[i], new.get(d.parent), d.start, d.end, d.kind, d.type, d.name, depths[i], *s.place(d.start), *s.place(d.end), exported, d.docstring, dump(d.meta) if d.meta else None, *named[i], n))
        if rows:
            yield _batch(rows, _KINDS, _DEFINITIONS)


def _overloads(defs: list[Definition], depths: list[int]) -> dict[int, int]:
    """Functions and methods of equal type and name under one parent count as one definition: the
    numbers of those that stay, and how many each stands for.  The others go with what is in them."""
    keys = [(d.parent, d.type, d.name) if d.type in ("function", "method") else None for d in defs]
    counts = Counter(keys)
    seen: set[tuple] = set()
    out: dict[int, int] = {}
    cut: int | None = None
    for i, key in enumerate(keys):
        again = key is not None and key in seen
        seen.add(key)
        if cut is not None and depths[i] > cut:
            continue
        cut = depths[i] if again else None
        if not again:
            out[i] = counts[key] if key is not None else 1
    return out


def _holders(sites: list[tuple[int, int]], defs: list[Definition]) -> list[int | None]:
    """For each place (start, end) the innermost definition that holds it: the last one to start
    that hasn't ended."""
    sides = sorted([(d.start, -d.end, 0, i) for i, d in enumerate(defs)] + [(a, -b, 1, i) for i, (a, b) in enumerate(sites)])
    out: list[int | None] = [None] * len(sites)
    stack: list[tuple[int, int]] = []
    for _, end, side, i in sides:
        stack = [x for x in stack if x[0] >= -end]
        if side:
            out[i] = stack[-1][1] if stack else None
        else:
            stack.append((-end, i))
    return out


def edges(content: str, ext: str, file: str) -> list[tuple[int, str, str, str, int]]:
    """A file's edges (seq, from, to, kind, line); of equal ones in a line the first stays."""
    s, defs, refs = read(content, ext)
    named = _named(_depths(defs), [d.name for d in defs], [d.kind for d in defs])
    first: dict[str, str] = {}
    for d, (qualified, _) in zip(defs, named):
        first.setdefault(d.name, qualified)
    kept: dict[tuple, None] = {}
    for (at, kind, name), holder in zip(refs, _holders([(at, at + len(name)) for at, _, name in refs], defs)):
        if kind == "calls":
            edge = (named[holder][0] if holder is not None else file, first.get(name, name), kind, s.place(at)[0])
        else:
            edge = (file, name, kind, s.place(at)[0])
        kept.setdefault(edge)
    return [(i, *edge) for i, edge in enumerate(kept)]


def _mapped_edges(batches):
    for batch in batches:
        rows = []
        for doc_id, ext, file, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ext", "file", "content"))):
            rows += [(doc_id, *edge) for edge in edges(content or "", ext, file)]
        if rows:
            yield _batch(rows, [pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32()], _EDGES)


def _code(docs: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    return docs.where(F.lower("ext").isin(*extensions)).select("doc_id", F.lower("ext").alias("ext"), "content")


def definitions(docs: DataFrame, grouped: bool = False, max_depth: int | None = None) -> DataFrame:
    """A row for each definition in documents (doc_id, ext, content) of the code extensions, with
    ``qualified_name``, the names from the outermost definition inwards, and ``parent_kind``.
    ``grouped`` keeps the first of overloads, with their number as ``overloads``."""
    return _code(docs).mapInArrow(partial(_mapped_definitions, grouped, max_depth), _DEFINITIONS)


def code_outline(docs: DataFrame, max_depth: int | None = None, grouped: bool = False, include_comments: bool = False) -> DataFrame:
    """Outline nodes of code; functions in class-like parents are methods.

    ``grouped`` joins overloads, ``include_comments`` adds docstrings and what they say.  A
    definition's parent is the innermost one around it, so definitions in source order are
    already in pre-order; all is done document by document and nothing is shuffled.
    """
    defs = definitions(docs, grouped, max_depth)
    meta = F.col("metadata")
    if include_comments:
        doc = parse_doc_json(doc_style(F.col("ext")), F.col("docstring"))
        extra = F.concat(F.lit('"docstring":'), F.regexp_extract(F.to_json(F.struct(F.col("docstring").alias("d"))), r'(?s)^\{"d":(.*)\}\z', 1), F.coalesce(F.concat(F.lit(',"doc":'), doc), F.lit("")))
        inner = F.regexp_replace(F.coalesce(meta, F.lit("{}")), r"\}\z", "")
        meta = F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(inner, F.when(inner == "{", "").otherwise(","), extra, F.lit("}"))).otherwise(meta)
    if grouped:
        inner = F.regexp_replace(F.coalesce(meta, F.lit("{}")), r"\}\z", "")
        meta = F.when(F.col("overloads") > 1, F.concat(inner, F.when(inner == "{", "").otherwise(","), F.lit('"overloads":'), F.col("overloads").cast("string"), F.lit("}"))).otherwise(meta)
    return defs.select("doc_id", F.col("def_id").alias("node_id"), "parent_id", F.col("name").alias("title"), "type", F.col("tree_depth").alias("depth"), "tree_depth", "line", "col", "end_line", "end_col", generate_id(F.col("name"), F.col("type"), F.col("line")).alias("id"), F.lit(None).cast("string").alias("anchor"), meta.alias("metadata")).select(*NODE_COLUMNS)


def signature(metadata: Column) -> Column:
    """``(a: T, b): R``; null for what takes no parameters, () for a function without any."""
    params = F.from_json(F.get_json_object(metadata, "$.parameters"), "array<struct<name:string,type:string>>")
    inner = F.array_join(F.transform(params, lambda p: F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"])), ", ")
    returns = F.get_json_object(metadata, "$.returnType")
    return F.when(params.isNotNull(), F.concat(F.lit("("), inner, F.lit(")"), F.coalesce(F.concat(F.lit(": "), returns), F.lit(""))))


def _toml_definitions(nodes: list[Node]) -> list[tuple]:
    """(node, number, parent's number, depth) of tables and keys as they come; tables side by side."""
    out: list[tuple] = []

    def walk(nodes: list[Node], parent: int | None, depth: int):
        for n in nodes:
            if n.kind == "section" and parent is not None:
                continue  # symbols keep tables side by side
            own = len(out)
            out.append((n, own, parent, depth))
            walk(n.children, own, depth + 1)

    def tables(nodes: list[Node]):
        for n in nodes:
            yield n
            yield from tables([c for c in n.children if c.kind == "section"])

    walk(sorted(tables(nodes), key=lambda n: n.span), None, 1)
    return out


def _mapped_toml(batches):
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
            found = _toml_definitions(parse_toml(content or ""))
            kinds = ["key" if n.kind == "property" else "table" for n, *_ in found]
            named = _named([depth for *_, depth in found], [n.title for n, *_ in found], kinds)
            rows += [(doc_id, "toml", own, parent, n.span[0], n.span[2], kind, n.kind, n.title, depth, *n.span, False, None, dump(n.meta) if n.meta else None, *name, 1) for (n, own, parent, depth), kind, name in zip(found, kinds, named)]
        if rows:
            yield _batch(rows, _KINDS, _DEFINITIONS)


def _with_toml(docs: DataFrame) -> DataFrame:
    """Definitions of TOML documents: tables and keys, as the parser nests them."""
    return _code(docs, ("toml",)).mapInArrow(_mapped_toml, _DEFINITIONS)


def symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, name, qualified_name, kind, start_line, end_line, exported, signature)."""
    named = definitions(docs).unionByName(_with_toml(docs))
    like = F.col("parent_kind").isin("class", "struct", "interface")
    for ext, kinds in CLASS_LIKE.items():
        like = F.when(F.col("ext") == ext, F.col("parent_kind").isin(*kinds) if kinds else F.lit(False)).otherwise(like)
    mapping = F.create_map(*[F.lit(x) for pair in SYMBOL_KIND.items() for x in pair])
    kind = F.when(F.coalesce(like, F.lit(False)) & (F.col("kind") == "function"), "method").otherwise(F.coalesce(F.try_element_at(mapping, F.col("kind")), F.lit("variable")))
    return named.select("doc_id", F.col("def_id").alias("seq"), "name", "qualified_name", kind.alias("kind"), F.col("line").alias("start_line"), F.col("end_line").alias("end_line"), "exported", signature(F.col("metadata")).alias("signature"))


def _file(docs: DataFrame) -> Column:
    """What calls outside of all definitions come from."""
    return F.coalesce("file_name", F.lit("<module>")) if "file_name" in docs.columns else F.lit("<module>")


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, from, to, kind, line): calls and imports of scripts and Python.

    ``from`` is the innermost definition around a call, or the file; ``to`` is the first symbol
    of that name in the file, or the bare name.  All of it is within a document, so nothing is
    shuffled or joined.
    """
    own = docs.where(F.col("doc_id").isNotNull() & F.lower("ext").isin(*SCRIPTS, *PYTHON))
    return own.select("doc_id", F.lower("ext").alias("ext"), _file(docs).alias("file"), "content").mapInArrow(_mapped_edges, _EDGES)


def _mapped_counts(batches):
    for batch in batches:
        files = zip(*(batch.column(c).to_pylist() for c in ("ext", "file", "content")))
        counts = [len(edges(content or "", ext.lower(), file)) if (ext or "").lower() in (*SCRIPTS, *PYTHON) else 0 for ext, file, content in files]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ext"), pa.array(counts, pa.int64())], ["doc_id", "ext", "n"])


def reference_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, ext, n): how many edges each document has, those of languages without any included."""
    return docs.select("doc_id", "ext", _file(docs).alias("file"), "content").mapInArrow(_mapped_counts, "doc_id string, ext string, n bigint")
