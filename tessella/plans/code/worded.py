"""Python, Ruby and Lua, whose blocks aren't in brackets."""

from __future__ import annotations

import ast
import re

from tessella.plans.code.languages import _plain_js
from tessella.plans.code.scanner import Definition, Language, Scanner

PYTHON = Language("python", (), comment="#", noise=re.compile(r"#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S), doc_style="pydoc")
RUBY = Language("ruby", (), frozenset(("class", "module")), re.compile(r"^=begin\b.*?^=end\b[^\n]*|#(?!\{)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S | re.M), "#=")
LUA = Language("lua", (), frozenset(), re.compile(r"--\[(=*)\[.*?\]\1\]|--[^\n]*|\[(=*)\[.*?\]\2\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S), "-")


def python_visibility(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


def python_definitions(text: str, references: bool = True) -> tuple[Scanner, list[Definition], list[tuple[int, str, str]]]:
    """Definitions and references (offset, kind, name) of a module by its syntax tree; of one that
    doesn't parse, definitions by indentation and calls by pattern."""
    s = Scanner(text, PYTHON)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return s, _python_by_lines(s), [(m.start(1), "calls", m[1]) for m in re.finditer(r"(?<!def )(?<!class )\b([^\W\d]\w*)\s*\(", s.mask) if m[1] not in ("if", "while", "return", "and", "or", "not", "in", "elif", "for", "print ")]
    raw = [line.encode() for line in text.split("\n")]

    def at(line: int, col: int) -> int:
        return s.lines[line - 1] + len(raw[line - 1][:col].decode(errors="replace"))

    def span(node) -> tuple[int, int]:
        return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)

    def source(node) -> str:
        return text[slice(*span(node))]

    def parameters(a: ast.arguments) -> list[dict]:
        out = []
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults

        def one(arg, default, star=""):
            p = {"name": star + arg.arg}
            if star and arg.annotation is not None:
                p = {"name": star + arg.arg, "type": source(arg.annotation)}
            elif arg.annotation is not None:
                p["type"] = source(arg.annotation)
            if default is not None:
                p |= {"optional": True, "defaultValue": source(default)}
            if p["name"] not in ("self", "cls"):
                out.append(p)

        for i, (arg, default) in enumerate(zip(plain, defaults)):
            one(arg, default)
            if a.posonlyargs and i == len(a.posonlyargs) - 1:
                out.append({"name": "/"})
        if a.vararg:
            one(a.vararg, None, "*")
        elif a.kwonlyargs:
            out.append({"name": "*"})
        for arg, default in zip(a.kwonlyargs, a.kw_defaults):
            one(arg, default)
        if a.kwarg:
            one(a.kwarg, None, "**")
        return out

    defs: list[Definition] = []

    def visit(node, parent: int | None):
        for child in ast.iter_child_nodes(node):
            own = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start, end = span(child)
                meta = {"visibility": python_visibility(child.name), "parameters": parameters(child.args), "returnType": source(child.returns) if child.returns is not None else None, "isAsync": True if isinstance(child, ast.AsyncFunctionDef) else None}
                own = _add(defs, start, end, "function", child.name, parent, meta, child)
            elif isinstance(child, ast.ClassDef):
                start, end = span(child)
                bases = [source(b) for b in child.bases] + [text[slice(at(k.lineno, k.col_offset), at(k.end_lineno, k.end_col_offset))] for k in child.keywords]
                own = _add(defs, start, end, "class", child.name, parent, {"bases": bases or None}, child)
            elif isinstance(node, ast.ClassDef) and isinstance(child, (ast.Assign, ast.AnnAssign)):
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                if isinstance(target, ast.Name) and child in node.body:
                    start, end = span(child)
                    kind = source(child.annotation) if isinstance(child, ast.AnnAssign) else None
                    own = _add(defs, start, end, "property", target.id, parent, {"visibility": python_visibility(target.id), "dataType": kind}, None)
            visit(child, own)

    visit(tree, None)
    refs = []
    for node in ast.walk(tree) if references else ():
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                refs.append((span(node.func)[0], "calls", node.func.id))
            elif isinstance(node.func, ast.Attribute):
                refs.append((span(node.func)[1] - len(node.func.attr), "calls", node.func.attr))
        elif isinstance(node, ast.Import):
            refs += [(span(a)[0], "imports", a.name) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            refs.append((span(node)[0], "imports", node.module))
    order = sorted(range(len(defs)), key=lambda i: (defs[i].start, -defs[i].end))
    new = {old: i for i, old in enumerate(order)}
    for d in defs:
        d.parent = None if d.parent is None else new[d.parent]
    return s, [defs[i] for i in order], sorted(refs)


def _add(defs: list[Definition], start: int, end: int, kind: str, name: str, parent: int | None, meta: dict, node) -> int:
    kept = {k: v for k, v in meta.items() if v is not None}
    inside = parent is not None and defs[parent].kind == "class"
    d = Definition(start, end, kind, name, parent, kept, "method" if kind == "function" and inside else kind, False, start)
    doc = None
    if node is not None and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
        doc = node.body[0].value.value.strip() or None  # inner indentation stays
    d.docstring = doc
    defs.append(d)
    return len(defs) - 1


def _python_by_lines(s: Scanner) -> list[Definition]:
    defs: list[Definition] = []
    stack: list[tuple[int, int]] = []
    for m in re.finditer(r"^([ \t]*)(?:(async)[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)", s.mask, re.M):
        indent = len(m[1].expandtabs())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1] if stack else None
        after = re.compile(rf"^[ \t]{{0,{len(m[1])}}}\S", re.M).search(s.mask, m.end())
        end = len(s.mask[: after.start()].rstrip()) if after else len(s.mask.rstrip())
        start = m.start(2) if m[2] else m.start(3)
        meta = {} if m[3] == "class" else {"visibility": python_visibility(m[4]), "isAsync": True if m[2] else None}
        stack.append((indent, _add(defs, start, max(end, m.end()), "class" if m[3] == "class" else "function", m[4], parent, meta, None)))
    return defs


_RUBY_TOKEN = re.compile(r"(?P<line>^|;|=|\()[^\S\n]*(?P<open>class|module|def|if|unless|while|until|case|for|begin)\b|\b(?P<do>do)\b|(?<![.:\w])(?P<end>end)\b(?!\s*[=:(])", re.M)
_RUBY_HEAD = re.compile(r"(?:class|module)\s+(?:[A-Z]\w*::)*(?P<type>[A-Z]\w*)|def\s+(?P<self>(?:self|\w+)\s*\.\s*)?(?P<name>[^\W\d]\w*[?!=]?|[+\-*/<>=!\[\]~%&|^]+)[^\S\n]*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\n;=]*)")


def ruby_definitions(text: str) -> tuple[Scanner, list[Definition]]:
    s = Scanner(text, RUBY)
    stack: list[int | None] = []
    loops = 0
    for m in _RUBY_TOKEN.finditer(s.mask):
        if m["end"]:
            if stack:
                i = stack.pop()
                if i is not None:
                    s.defs[i].end = m.end()
            continue
        word = m["open"] or "do"
        if word == "do":
            if loops and s.mask.rfind("\n", 0, m.start()) <= loops:
                loops = 0
                continue  # the do of a loop
            stack.append(None)
            continue
        at = m.start("open")
        if word in ("while", "until", "for"):
            loops = at
        parent = next((i for i in reversed(stack) if i is not None), None)
        head = _RUBY_HEAD.match(s.mask, at) if word in ("class", "module", "def") else None
        if not head or head["type"] is None and not re.match(r"[^\W\d]", head["name"] or ""):
            if not (head and word == "def" and re.match(r"[^\S\n]*=(?!=)", s.mask[head.end() :])):
                stack.append(None)
            continue
        if head["type"]:
            s.defs.append(Definition(at, len(text), word, head["type"], parent, {}, word, False, at))
        else:
            a, b = head.span("params")
            inner = (a + 1, b - 1) if s.mask[a:b].startswith("(") else (a, b)
            params = []
            for i, j in s.split(*inner):
                part = re.match(rf"\s*([^\W\d]\w*)\s*=(.*)", s.text[i:j], re.S)
                params.append({"name": part[1], "optional": True, "defaultValue": part[2].strip()} if part else {"name": s.source(i, j)})
            owner = s.defs[parent].kind if parent is not None else None
            meta = {"parameters": params} | ({"isStatic": True} if head["self"] else {})
            end = re.match(r"[^\S\n]*=(?!=)", s.mask[head.end() :])
            d = Definition(at, len(text), "function", head["name"], parent, meta, "method" if owner in ("class", "module") else "function", False, at)
            s.defs.append(d)
            if end:
                d.end = s.until(head.end(), len(text), "\n")
                continue
        stack.append(len(s.defs) - 1)
    return s, s.defs


_LUA_TOKEN = re.compile(r"\b(?P<word>function|if|do|repeat|end|until|for|while)\b")
_LUA_HEAD = re.compile(r"function\s+(?:[\w.]+[.:])?(?P<name>[^\W\d]\w*)\s*(?=\()")


def lua_definitions(text: str) -> tuple[Scanner, list[Definition]]:
    s = Scanner(text, LUA)
    stack: list[int | None] = []
    for m in _LUA_TOKEN.finditer(s.mask):
        word = m["word"]
        if word in ("for", "while"):
            continue  # their do opens the block
        if word in ("end", "until"):
            if stack and (i := stack.pop()) is not None:
                s.defs[i].end = m.end()
            continue
        head = _LUA_HEAD.match(s.mask, m.start()) if word == "function" else None
        if not head:
            stack.append(None)
            continue
        local = re.search(r"\blocal\s+$", s.mask[: m.start()])
        close = s.close(head.end())
        parent = next((i for i in reversed(stack) if i is not None), None)
        start = local.start() if local else m.start()
        meta = {"parameters": _plain_js(s, head.end() + 1, close)} | ({"isLocal": True} if local else {})
        s.defs.append(Definition(start, len(text), "function", head["name"], parent, meta, "function", False, start))
        stack.append(len(s.defs) - 1)
    return s, s.defs
