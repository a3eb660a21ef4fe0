"""Outlines of nested data: JSON, YAML, XML and TOML.

These need parsers, so documents go through Python in Arrow batches, one call for each document;
what comes back is the node table's rows, in pre-order, and needs no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

_FIELDS = [("doc_id", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("title", pa.string()), ("type", pa.string()), ("depth", pa.int32()), ("tree_depth", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("end_col", pa.int32()), ("id", pa.string()), ("anchor", pa.string()), ("metadata", pa.string())]
ROWS = "doc_id string, node_id int, parent_id int, title string, type string, depth int, tree_depth int, line int, col int, end_line int, end_col int, id string, anchor string, metadata string, error string"


def slug_id(title: str, kind: str, line: int | None = None) -> str:
    return f"{kind}-{re.sub('[^a-z0-9]', '-', title.lower())}" + (f"-{line}" if line else "")


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Node:
    """A node of a parsed document."""

    __slots__ = ("title", "kind", "meta", "children", "span", "depth", "identity")

    def __init__(self, title: str, kind: str, meta: dict | None = None, span: tuple[int, int, int, int] | None = None, identity: str | None = None):
        self.title, self.kind, self.span, self.identity = title, kind, span, identity
        self.meta = {k: v for k, v in (meta or {}).items() if v is not None}
        self.children: list[Node] = []
        self.depth = 0


def rows(doc_id: str, roots: list[Node], max_depth: int | None) -> Iterator[tuple]:
    """Node rows in pre-order; nodes below ``max_depth`` are left out with their subtrees."""
    count = 0
    stack = [(n, None, 1) for n in reversed(roots)]
    while stack:
        node, parent, depth = stack.pop()
        if max_depth and depth > max_depth:
            continue
        span = node.span or (None,) * 4
        yield doc_id, count, parent, node.title, node.kind, depth, depth, *span, node.identity or slug_id(node.title, node.kind, span[0]), None, dump(node.meta) if node.meta else None, None
        stack += [(c, count, depth + 1) for c in reversed(node.children)]
        count += 1


def _mapped(parse: Callable[[str], list[Node]], max_depth: int | None, batches):
    schema = pa.schema([*_FIELDS, ("error", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
            try:
                out += rows(doc_id, parse(content or ""), max_depth)
            except (ValueError, RecursionError) as e:
                out.append((doc_id, *[None] * 13, str(e) or type(e).__name__))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def parsed(docs: DataFrame, parse: Callable[[str], list[Node]], max_depth: int | None, mode: str = "FAILFAST") -> DataFrame:
    """Node rows of ``parse``.  Of a document that can't be parsed, FAILFAST fails the job,
    DROPMALFORMED gives nothing, and PERMISSIVE one row with its ``error``."""
    found = docs.select("doc_id", "content").mapInArrow(partial(_mapped, parse, max_depth), ROWS)
    if mode == "PERMISSIVE":
        return found
    if mode == "FAILFAST":
        found = found.where("if(error is null, true, raise_error(concat(doc_id, ': ', error)))")
    return found.where("error is null").drop("error")


def _ordered(obj: dict) -> list[tuple[str, object]]:
    """Items as an ECMAScript object lists them: integer keys first, in their order."""
    whole = [k for k in obj if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1]
    if not whole:
        return list(obj.items())
    index = set(whole)
    return [(k, obj[k]) for k in sorted(whole, key=int)] + [(k, v) for k, v in obj.items() if k not in index]


def _json_type(value: object) -> str:
    return "null" if value is None else "array" if isinstance(value, list) else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "object" if isinstance(value, dict) else "string"


def _not_json(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_json(content: str) -> list[Node]:
    """The schema of a JSON value: properties of objects, and of arrays' first elements."""
    try:
        data = json.loads(content, parse_constant=_not_json)
    except ValueError as e:
        raise ValueError(f"Invalid JSON: {e}") from None

    def walk(obj: dict, path: str) -> list[Node]:
        out = []
        for key, value in _ordered(obj):
            own = f"{path}.{key}" if path else key
            node = Node(key, "property", {"dataType": _json_type(value), "required": value is not None, "path": own}, identity=slug_id(key, "property"))
            if isinstance(value, dict):
                node.children = walk(value, own)
            elif isinstance(value, list) and value and isinstance(value[0], dict):
                node.children = walk(value[0], own + "[]")
            out.append(node)
        return out

    if isinstance(data, dict):
        return walk(data, "")
    return walk(data[0], "[]") if isinstance(data, list) and data and isinstance(data[0], dict) else []


@lru_cache(maxsize=2)
def _yaml_loader(fast: bool = False):
    """A safe loader; with ``fast`` libyaml reads the text, if it is there."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader) if fast else yaml.SafeLoader):
        """Scalars as YAML 1.2's core schema resolves them."""

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?0b[01]+)$", "-+0123456789"),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
        ("merge", r"^<<$", "<"),
        ("timestamp", r"^\d{4}-\d\d-\d\d$|^\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?$", "0123456789"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    def number(loader, node):
        text = loader.construct_scalar(node).replace("_", "")
        sign = -1 if text[0] == "-" else 1
        digits = text.lstrip("+-")
        base = {"0o": 8, "0x": 16, "0b": 2}.get(digits[:2], 10)
        return sign * int(digits[2:] if base != 10 else digits, base)

    def mapping(loader, node):
        loader.flatten_mapping(node)
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            key = "null" if key is None else str(key).lower() if isinstance(key, bool) else str(key)
            if key in out:
                raise ValueError("duplicated mapping key")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor("tag:yaml.org,2002:int", number)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


#: Lines that libyaml and the loader in Python read alike: plain keys, and list marks, with plain or
#: quoted scalars or flow collections of plain ones.
_YAML_SCALAR = r"(?:[A-Za-z0-9_./+-][A-Za-z0-9_./+-]*(?: [A-Za-z0-9_./+-]+)*|'[A-Za-z0-9_./ +-]*'|\"[A-Za-z0-9_./ +-]*\")"
_YAML_FLOW = rf"(?:\[(?:{_YAML_SCALAR}(?:, {_YAML_SCALAR})*)?\]|\{{(?:\w+: {_YAML_SCALAR}(?:, \w+: {_YAML_SCALAR})*)?\}})"
_YAML_PLAIN = re.compile(rf"(?> *(?:- )*(?:[A-Za-z0-9_]+:(?: (?:{_YAML_SCALAR}|{_YAML_FLOW}))?|- ?(?:{_YAML_SCALAR}|{_YAML_FLOW})|)(?:\n|\Z))*+", re.A)


def _load_yaml(content: str) -> object:
    import yaml

    if _YAML_PLAIN.fullmatch(content):
        try:
            return yaml.load(content, _yaml_loader(True))  # a safe loader
        except (yaml.YAMLError, ValueError):
            pass  # the other one tells what is wrong
    return yaml.load(content, _yaml_loader())  # a safe loader


def parse_yaml(content: str) -> list[Node]:
    """Keys of mappings and indices of sequences, with scalars' values."""
    import datetime

    import yaml

    try:
        data = _load_yaml(content)
    except (yaml.YAMLError, ValueError) as e:
        raise ValueError(f"Invalid YAML: {e}") from None

    def walk(value: object, path: str) -> list[Node]:
        entries = [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else _ordered(value) if isinstance(value, dict) else []
        out = []
        for key, v in entries:
            own = f"{path}.{key}" if path else key
            date = isinstance(v, (datetime.date, datetime.datetime))
            kind = "object" if date else _json_type(v)
            node = Node(key, kind, {"path": own, "dataType": kind, "isArray": isinstance(v, list), "value": None if date or isinstance(v, (dict, list)) else v})
            node.children = walk(v, own)
            out.append(node)
        return out

    return walk(data, "")


def parse_xml(content: str) -> list[Node]:
    """Elements: ``text`` for those of text only, ``element`` for others, and ``array`` for a
    repeated name, with the children of its first three elements."""
    root: dict = {}
    stack: list[dict] = [root]
    texts: list[list[str]] = [[]]

    def add(parent: dict, name: str, value: object):
        if name in parent:
            if not isinstance(parent[name], list):
                parent[name] = [parent[name]]
            parent[name].append(value)
        else:
            parent[name] = value

    def start(name, attrs):
        stack.append({f"@_{k}": v for k, v in attrs.items()})
        texts.append([])

    def end(name):
        own, text = stack.pop(), "".join(texts.pop()).strip()
        if text and own:
            own["#text"] = text
        add(stack[-1], name, own or text)

    parser = expat.ParserCreate()
    parser.ordered_attributes = False
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: texts[-1].append(data)
    parser.XmlDeclHandler = lambda version, encoding, alone: root.__setitem__("?xml", {"@_version": version} | ({"@_encoding": encoding} if encoding else {}))
    parser.ProcessingInstructionHandler = lambda target, data: add(stack[-1], f"?{target}", "")
    parser.EntityDeclHandler = _no_entities
    if content.strip():
        try:
            parser.Parse(content.lstrip("\ufeff").lstrip().encode(), True)
        except (expat.ExpatError, ValueError) as e:
            raise ValueError(f"Invalid XML: {e}") from None

    def walk(obj: dict, path: str) -> list[Node]:
        out = []
        for key, value in _ordered(obj):
            if key.startswith("@_"):
                continue
            own = f"{path}.{key}" if path else key
            array, element = isinstance(value, list), isinstance(value, dict)
            attributes = element and any(k.startswith("@_") for k in value)
            node = Node(key, "array" if array else "element" if element else "text", {"path": own, "hasAttributes": attributes, "isArray": array, "textContent": value if isinstance(value, str) else None})
            if element:
                node.children = walk(value, own)
            elif array:
                for i, item in enumerate(value[:3]):
                    if isinstance(item, dict):
                        node.children += walk(item, f"{own}[{i}]")
            out.append(node)
        return out

    return walk(root, "")


def _no_entities(*_):
    raise ValueError("entity declarations are not read")


# TOML

_TOML_VALUE = re.compile(r"\"\"\"(?:\\.|[^\\])*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|#[^\n]*|[\[\]{},\n]", re.S)
_TOML_TABLE = re.compile(r"[ \t]*(\[\[?)[ \t]*([^\]\n]+?)[ \t]*\]\]?")
_TOML_KEY = re.compile(r"[ \t]*((?:[A-Za-z0-9_-]+|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'))*)[ \t]*=[ \t]*")


def _toml_end(text: str, at: int, end: int, stops: str) -> int:
    """Where the value that starts at ``at`` ends: at a line end, a comment or, outside of
    brackets, one of ``stops``; at ``end`` at the latest."""
    depth = 0
    for m in _TOML_VALUE.finditer(text, at):
        if m.start() >= end:
            break
        t = m[0]
        if t[0] == "#" and not depth or not depth and (t == "\n" or t in stops):
            return m.start()
        depth += (t in "[{") - (t in "]}")
    return end


def parse_toml(content: str) -> list[Node]:
    """Tables, and pairs with their values' raw texts; pairs of inline tables nest.  A dotted
    table goes under the longest of its prefixes that is a table; of equal names the last one is
    the parent."""
    text = content.replace("\r\n", "\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(starts, offset)
        return line, offset - starts[line - 1] + 1

    def pairs(at: int, end: int, stops: str) -> tuple[list[Node], int]:
        out: list[Node] = []
        while at < end:
            m = _TOML_KEY.match(text, at, end)
            if not m:
                break
            stop = _toml_end(text, m.end(), end, stops)
            value = text[m.end() : stop].rstrip()
            first, last = place(m.start(1)), place(m.end() + len(value))
            simple = not (m[1][0] in "'\"" and "." in re.sub(r"\"[^\"]*\"|'[^']*'", "", m[1]))
            node = Node(m[1], "property", {"value": value}, (*first, *last)) if simple else Node("<key>", "property", {"value": value}, (*first, *last))
            if value.startswith("{"):
                node.children = pairs(m.end() + 1, m.end() + len(value) - 1, ",")[0]
            out.append(node)
            at = stop + 1 if stops else stop
        return out, at

    roots: list[Node] = []
    current: Node | None = None
    at = 0
    while at < len(text):
        line_end = text.find("\n", at)
        line_end = len(text) if line_end < 0 else line_end
        m = _TOML_TABLE.match(text, at, line_end)
        if m:
            current = Node(m[2], "section", None, (*place(m.start(1)), *place(line_end)))
            roots.append(current)
            at = line_end + 1
            continue
        found, after = pairs(at, len(text), "")
        if found:
            (current.children if current else roots).extend(found)
            if current:
                current.span = (*current.span[:2], *found[-1].span[2:])
            at = after
            continue
        at = line_end + 1
    by_name = {n.title: n for n in roots if n.kind == "section"}
    out = []
    for node in roots:
        parts = node.title.split(".") if node.kind == "section" else []
        parent = next((by_name[p] for i in range(len(parts) - 1, 0, -1) if (p := ".".join(parts[:i])) in by_name), None)
        (parent.children if parent is not None and parent is not node else out).append(node)
    return out


def json_outline(docs: DataFrame, max_depth: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    return parsed(docs, parse_json, max_depth, mode)


def yaml_outline(docs: DataFrame, max_depth: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    return parsed(docs, parse_yaml, max_depth, mode)


def xml_outline(docs: DataFrame, max_depth: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    return parsed(docs, parse_xml, max_depth, mode)


def toml_outline(docs: DataFrame, max_depth: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    return parsed(docs, parse_toml, max_depth, mode)
