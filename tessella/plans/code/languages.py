"""Declaration rules of the languages that the scanner reads."""

from __future__ import annotations

import re
from collections.abc import Callable

from tessella.plans.code.scanner import C_NOISE, GEN, ID, Language, Rule, Scanner


def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


def _rule(pattern: str, make: Callable, *where: str) -> Rule:
    return Rule(_rx(pattern), make, frozenset(where) or None)


def _block(kind: str, place: str | None = None, meta: Callable | None = None, type: Callable | None = None):
    """A definition with a block as its body, or that ends without one."""

    def make(s: Scanner, m: re.Match, where: str) -> int | None:
        stops = "{;\n" if s.language.newline else "{;"
        at = s.until(m.end(), len(s.mask), "{;")
        if s.language.newline:
            line = s.until(m.end(), len(s.mask), stops)
            if line < at and not s.mask[line:at].strip() == "" and not re.match(r"\s*(?:\{|:|extends|implements|with|where|derives)", s.mask[line:]):
                at = line
        info = meta(s, m) if meta else None
        shown = type(s, m) if type else ""
        if at < len(s.mask) and s.mask[at] == "{":
            close = s.close(at)
            return s.add(kind, m["name"], m.start(), close + 1, info, (at + 1, close, place or kind), shown, m.start("name"))
        return s.add(kind, m["name"], m.start(), at, info, None, shown, m.start("name"))

    return make


def _line(kind: str, meta: Callable | None = None):
    """A definition that ends with its statement."""

    def make(s: Scanner, m: re.Match, where: str) -> int:
        end = s.until(m.end(), len(s.mask), ";\n" if s.language.newline else ";")
        return s.add(kind, m["name"].strip(), m.start(), end, meta(s, m) if meta else None, None, "", m.start("name"))

    return make


def _members(place: str, kind: str, nested: str | None = None, noise: str = r"(?:@\w+(?:\([^()]*\))?\s*|\[[^\]]*\]\s*|#\[[^\]]*\]\s*)*"):
    """A walker of comma-separated names, as enums have them."""

    def walk(s: Scanner, at: int, end: int) -> None:
        stop = s.until(at, end, ";")
        for a, b in s.split(at, stop):
            m = _rx(rf"\s*{noise}(?P<name>{ID})").match(s.mask, a, b)
            if m:
                brace = s.mask.find("{", m.end(), b)
                body = (brace + 1, s.close(brace), nested) if nested and brace >= 0 else None
                s.exported = False
                first = m.start("name") if noise and s.mask[m.start() : m.start("name")].lstrip().startswith("#") else a + len(s.mask[a:b]) - len(s.mask[a:b].lstrip())
                s.add(kind, m["name"], first, b, None, body, "", m.start("name"))
        if stop < end:
            s.walk(stop + 1, end, place)

    return walk


def _enum(kind: str = "enum", place: str = "enum", meta: Callable | None = None, nested: str | None = None):
    members = _members(place, "enum-value", nested)

    def make(s: Scanner, m: re.Match, where: str) -> int | None:
        at = s.until(m.end(), len(s.mask), "{;")
        if at >= len(s.mask) or s.mask[at] != "{":
            return s.add(kind, m["name"], m.start(), at, meta(s, m) if meta else None)
        close = s.close(at)
        s.add(kind, m["name"], m.start(), close + 1, meta(s, m) if meta else None, None, "", m.start("name"))
        s.open.append(len(s.defs) - 1)
        s.access.append(None)
        members(s, at + 1, close)
        s.access.pop()
        s.open.pop()
        return close + 1

    return make


def _words(m: re.Match) -> list[str]:
    return re.sub(r"@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|\[[^\]]*\]", " ", m["mods"] or "").split()


def _modifiers(m: re.Match, levels: tuple[str, ...]) -> dict:
    words = _words(m)
    found = [v for v in levels if v in words]
    return {"visibility": found[-1] if found else None, "isStatic": True if "static" in words else None, "isAbstract": True if "abstract" in words else None}


# Parameters: each takes the places within the brackets


def _typed_after(s: Scanner, a: int, b: int) -> list[dict]:
    """``name: type = default``, as TypeScript has it."""
    out = []
    for i, j in s.split(a, b):
        part = s.mask[i:j]
        first = i + re.match(r"\s*(?:@\w+(?:\([^()]*\))?\s*|(?:public|private|protected|readonly|override)\s+)*", part).end()
        equals = next((e for e, _ in _marks(s, first, j, "=")), -1)
        left = equals if equals >= 0 else j
        colon = next((c for c, _ in _marks(s, first, left, ":")), -1)
        name = s.source(first, colon if colon >= 0 else left)
        p: dict = {"name": name.removesuffix("?").rstrip()}
        if colon >= 0:
            p["type"] = s.source(colon + 1, left)
        if name.endswith("?") or equals >= 0:
            p["optional"] = True
        if equals >= 0:
            p["defaultValue"] = s.source(equals + 1, j)
        out.append(p)
    return out


def _marks(s: Scanner, a: int, b: int, mark: str):
    """Places of a mark outside of brackets; = is none of =>, ==, <= and the like."""
    at = a
    while at < b:
        c = s.mask[at]
        if c in "([{":
            at = min(s.pair.get(at, at), b)
        elif c == mark and not (mark == "=" and (s.mask[at + 1 : at + 2] in ("=", ">") or s.mask[at - 1] in "=<>!")):
            yield at, at + 1
        at += 1


def _plain_js(s: Scanner, a: int, b: int) -> list[dict]:
    out = []
    for i, j in s.split(a, b):
        equals = next((e for e, _ in _marks(s, i, j, "=")), -1)
        name = s.source(i, equals if equals >= 0 else j)
        out.append({"name": name} | ({"optional": True, "defaultValue": s.source(equals + 1, j)} if equals >= 0 else {}))
    return out


def _typed_before(spread: bool = False, defaults: bool = True):
    """``type name``, as Java, C# and C++ have it."""

    def parse(s: Scanner, a: int, b: int) -> list[dict]:
        out = []
        for i, j in s.split(a, b):
            equals = next((e for e, _ in _marks(s, i, j, "=")), -1)
            if equals >= 0 and not defaults:
                continue
            text = s.source(i, equals if equals >= 0 else j)
            if "..." in text and not spread:
                if not defaults:
                    continue
            if "..." in text and spread:
                out.append({"name": text})
                continue
            text = re.sub(r"^(?:@[\w.]+(?:\([^()]*\))?\s*|\[[^\]]*\]\s*|(?:final|ref|out|in|this|params|const|volatile|register)\s+)*", "", text)
            m = re.match(r"(.*?[\s>\]])\s*([*&]*\s*" + ID + r"(?:\s*\[[^\]]*\])*)$", text, re.S) or (None if defaults else re.match(r"(.*?)([*&]+\s*" + ID + r"|[*&]+)$", text, re.S))
            out.append({"name": m[2].strip(), "type": m[1].strip()} if m else {"name": "" if not defaults else text, **({"type": text} if not defaults else {})})
        return out

    return parse


_java_parameters = _typed_before(spread=True)
_cs_parameters = _typed_before()
_cpp_parameters = _typed_before(defaults=False)


def _named_types(drop: str = "", user_types: bool = True, label_first: bool = True):
    """``name: Type``, as Kotlin, Swift and Scala have it; only plain named types count if asked."""

    def parse(s: Scanner, a: int, b: int) -> list[dict]:
        out = []
        for i, j in s.split(a, b):
            equals = next((e for e, _ in _marks(s, i, j, "=")), -1)
            end = equals if equals >= 0 else j
            colon = next((c for c, _ in _marks(s, i, end, ":")), -1)
            words = re.sub(r"@\w+(?:\([^()]*\))?", " ", s.mask[i : colon if colon >= 0 else end]).split()
            words = [w for w in words if w not in drop.split()] or words
            kind = s.source(colon + 1, end) if colon >= 0 else None
            if user_types and kind is not None:
                kind = _user_type(kind)
            out.append({"name": (words[0] if label_first else words[-1]) if words else ""} | ({"type": kind} if kind else {}))
        return out

    return parse


def _user_type(text: str) -> str | None:
    text = re.sub(r"^(?:inout|@\w+|vararg)\s+", "", text.strip())
    return text if re.fullmatch(rf"{ID}(?:\s*\.\s*{ID})*\s*(?:{GEN})?", text) else None


# TypeScript and JavaScript

_TS_LEAD = _rx(r"(?P<decorators>(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)*)(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?")
_TS_MODS = r"(?P<mods>(?:(?:public|private|protected|static|abstract|override|readonly|async|declare|get|set|accessor)\s+)*)"


def _ts_decorators(s: Scanner, at: int) -> list[str] | None:
    m = _TS_LEAD.match(s.mask, s.export_at)
    texts = [s.text[d.start() + m.start("decorators") : d.end() + m.start("decorators")].strip() for d in re.finditer(r"@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?", m["decorators"])] if m and m.end() <= at else []
    return texts or None


def _ts_class(s: Scanner, m: re.Match, where: str) -> int | None:
    at = s.until(m.end(), len(s.mask), "{;")
    if at >= len(s.mask) or s.mask[at] != "{":
        return None
    meta = {"isAbstract": True if m["abstract"] else None, "typeParameters": s.source(*m.span("tp")) if m["tp"] else None, "decorators": _ts_decorators(s, m.start())} if s.language.name != "javascript" else {}
    start = m.start() if s.exported or not meta.get("decorators") else s.export_at
    close = s.close(at)
    return s.add("class", m["name"], start, close + 1, meta, (at + 1, close, "class"), "", m.start("name"))


def _return_type(s: Scanner, at: int, stops: str) -> tuple[str | None, int]:
    """The type after a colon, and where it ends; an object type's braces belong to it."""
    m = _rx(r"\s*:\s*").match(s.mask, at)
    if not m:
        return None, at
    first = i = m.end()
    while i < len(s.mask):
        c = s.mask[i]
        if c == "{" and not s.mask[first:i].strip() or c == "{" and s.mask[first:i].rstrip()[-1:] in ("|", "&", "<", ",", ":"):
            i = s.close(i)
        elif c in "([":
            i = s.close(i)
        elif c == "=" and s.mask[i + 1 : i + 2] == ">" and stops == "=>" and s.mask[first:i].rstrip()[-1:] != ")":
            break
        elif c in "{;" or c == "\n" and s.mask[first:i].strip() and stops != "=>":
            break
        i += 1
    return s.source(first, i), i


def _ts_callable(s: Scanner, at: int, mods: list[str], arrow: bool = False) -> tuple[dict, int]:
    """Metadata of the function whose parameters open at ``at``, and where its head ends."""
    typed = s.language.name != "javascript"
    close = s.close(at)
    meta: dict = {}
    if typed:
        meta["visibility"] = next((v for v in mods if v in ("public", "private", "protected")), None)
    meta["isStatic"] = True if "static" in mods else None
    meta["isAbstract"] = True if typed and "abstract" in mods else None
    meta["parameters"] = (_typed_after if typed else _plain_js)(s, at + 1, close)
    if typed:
        meta["returnType"], end = _return_type(s, close + 1, "=>" if arrow else "")
    else:
        end = close + 1
    return meta, end


def _ts_function(s: Scanner, m: re.Match, where: str) -> int | None:
    meta, end = _ts_callable(s, m.end(), [])
    if m["tp"]:
        meta["typeParameters"] = s.source(*m.span("tp"))
    at = end + len(s.mask[end:]) - len(s.mask[end:].lstrip())
    if at >= len(s.mask) or s.mask[at] != "{":
        return None if s.language.name == "javascript" else s.until(end, len(s.mask), ";\n")
    close = s.close(at)
    return s.add("function", m["name"], m.start(), close + 1, meta, (at + 1, close, "block"), "", m.start("name"))


def _ts_method(s: Scanner, m: re.Match, where: str) -> int | None:
    mods = (m["mods"] or "").split()
    meta, end = _ts_callable(s, m.end(), mods)
    if m["tp"]:
        meta["typeParameters"] = s.source(*m.span("tp"))
    at = end + len(s.mask[end:]) - len(s.mask[end:].lstrip())
    if at < len(s.mask) and s.mask[at] == "{":
        close = s.close(at)
        return s.add("function", m["name"], m.start(), close + 1, meta, (at + 1, close, "block"), "", m.start("name"))
    if "abstract" in mods:
        return s.add("function", m["name"], m.start(), end, meta, None, "", m.start("name"))
    return end  # an overload signature


def _ts_property(s: Scanner, m: re.Match, where: str) -> int:
    mods = (m["mods"] or "").split()
    end = s.until(m.end(), len(s.mask), ";\n}")
    equals = next((e for e, _ in _marks(s, m.end(), end, "=")), -1)
    colon = _rx(r"\s*[?!]?\s*:").match(s.mask, m.end("name"))
    meta: dict = {"visibility": next((v for v in mods if v in ("public", "private", "protected")), None), "isStatic": True if "static" in mods else None}
    if s.language.name == "javascript":
        meta = {"isStatic": meta["isStatic"]}
    elif colon:
        meta["dataType"] = s.source(colon.end(), equals if equals >= 0 else end)
    if equals >= 0:
        while (brace := s.mask.find("{", equals, end)) >= 0 or end < len(s.mask) and s.mask[end - 1 : end] == "{":
            if brace < 0:
                break
            end = max(end, s.close(brace) + 1)
            s.blocks(brace, end)
            break
    return s.add("property", m["name"], m.start(), end, meta, None, "", m.start("name"))


_VALUE = _rx(rf"(?:async\s+)?(?:(?P<function>function\b)\s*\*?\s*(?:{ID})?\s*(?P<tp>{GEN})?\s*(?=\()|(?P<tp2>{GEN})?\s*(?P<open>\()|(?P<one>{ID})\s*=>)")


def _ts_value(s: Scanner, m: re.Match, where: str) -> int | None:
    """``const f = () => ...`` and the like."""
    v = _VALUE.match(s.mask, m.end())
    if not v:
        return None
    if v["one"]:
        meta, end = {"parameters": []}, v.end() - 2
    else:
        at = v.start("open") if v["open"] else v.end()
        meta, end = _ts_callable(s, at, [], arrow=not v["function"])
        tp = "tp" if v["function"] else "tp2"
        if v[tp] and s.language.name != "javascript":
            meta["typeParameters"] = s.source(*v.span(tp))
    if v["function"]:
        at = s.until(end, len(s.mask), "{;")
    else:
        arrow = _rx(r"\s*=>\s*").match(s.mask, end)
        if not arrow:
            return None
        at = arrow.end()
    if at < len(s.mask) and s.mask[at] == "{":
        close = s.close(at)
        end = close + 1
        body = (at + 1, close, "block")
    else:
        end = at
        while end < len(s.mask) and s.mask[end] not in ";\n":
            end = s.close(end) + 1 if s.mask[end] in "([{" else end + 1
        body = None
    if end < len(s.mask) and s.mask[end] == ";":
        end += 1
    return s.add("function", m["name"], m.start(), end, meta, body, "", m.start("name"))


_TS_RULES = (
    _rule(rf"(?P<abstract>abstract\s+)?class\s+(?P<name>{ID})\s*(?P<tp>{GEN})?", _ts_class),
    _rule(rf"(?:async\s+)?function\s+(?P<name>{ID})\s*(?P<tp>{GEN})?\s*(?=\()", _ts_function),
    _rule(rf"(?:const|let)\s+(?P<name>{ID})\s*(?::(?:[^=;\n]|=>)+)?=\s*", _ts_value),
    _rule(rf"{_TS_MODS}(?:\*\s*)?(?P<name>{ID})\s*\??\s*(?P<tp>{GEN})?\s*(?=\()", _ts_method, "class"),
    _rule(rf"{_TS_MODS}(?P<name>{ID})\s*[?!]?[^\S\n]*(?=[:=;\n}}]|\Z)", _ts_property, "class"),
)
_TS_NOISE = _rx(C_NOISE + r"|`(?:\\.|[^`\\])*`")
TYPESCRIPT = Language("typescript", (
    _rule(rf"interface\s+(?P<name>{ID})\s*(?:{GEN})?", _block("interface", "signature")),
    _rule(rf"type\s+(?P<name>{ID})\s*(?:{GEN})?\s*=", _line("type")),
    _rule(rf"(?:const\s+)?enum\s+(?P<name>{ID})", _block("enum", "signature")),
    *_TS_RULES,
), noise=_TS_NOISE, newline=True, lead=_TS_LEAD)
JAVASCRIPT = Language("javascript", (
    *_TS_RULES,
    _rule(rf"{ID}(?:\.{ID})*\.(?P<name>{ID})\s*=\s*", _ts_value, "top", "block"),
), noise=_TS_NOISE, newline=True, lead=_TS_LEAD)


# Java and C#

_TYPE = rf"(?!(?:return|new|throw|else|case|package|import|using|event|class|interface|enum|struct|record|delegate|operator|implicit|explicit|public|private|protected|internal|static|abstract|final|sealed|virtual|override|readonly|const|async|partial|extern|unsafe|synchronized|native|default|transient|volatile|required)\b){ID}(?:\s*\.\s*{ID})*\s*(?:{GEN})?(?:\s*\.\s*{ID})*(?:\s*\[[\s,]*\]|\s*\?)*"
_JAVA_MODS = r"(?P<mods>(?:(?:@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|public|private|protected|static|abstract|final|synchronized|native|default|transient|volatile|strictfp|sealed|non-sealed)\s+)*)"
_JAVA_LEVELS = ("public", "private", "protected")


def _member_function(levels: tuple[str, ...], parameters: Callable):
    def make(s: Scanner, m: re.Match, where: str) -> int | None:
        groups = m.groupdict()
        kind = groups.get("type")
        if not kind and s.open and m["name"] != s.defs[s.open[-1]].name:
            return None
        close = s.close(m.end())
        meta = _modifiers(m, levels) | {"parameters": parameters(s, m.end() + 1, close), "returnType": s.source(*m.span("type")) if kind else None}
        tp = groups.get("tp") or groups.get("tp2")
        if tp:
            meta["typeParameters"] = tp.strip()
        at = s.until(close + 1, len(s.mask), "{;")
        arrow = s.mask.find("=>", close, at)
        if arrow >= 0:
            at = s.until(arrow, len(s.mask), ";")
        if at < len(s.mask) and s.mask[at] == "{":
            end = s.close(at)
            return s.add("function", m["name"], m.start(), end + 1, meta, (at + 1, end, "block"), "", m.start("name"))
        return s.add("function", m["name"], m.start(), min(at + 1, len(s.mask)), meta, None, "", m.start("name"))

    return make


def _member_field(levels: tuple[str, ...]):
    def make(s: Scanner, m: re.Match, where: str) -> int:
        at = s.until(m.end(), len(s.mask), ";")
        s.blocks(m.end(), at)
        return s.add("field", m["name"], m.start(), min(at + 1, len(s.mask)), _modifiers(m, levels) | {"dataType": s.source(*m.span("type"))}, None, "", m.start("name"))

    return make


def _mods(levels: tuple[str, ...]):
    return lambda s, m: _modifiers(m, levels)


_java_in = ("class", "interface", "enum", "annotation")
JAVA = Language("java", (
    _rule(r"package\s+(?P<name>[\w]+(?:\s*\.\s*\w+)+)(?=\s*;)", _line("package"), "top"),
    _rule(r"import\s+(?:static\s+)?(?P<name>\w+(?:\s*\.\s*\w+)+)", _line("import"), "top"),
    _rule(rf"{_JAVA_MODS}class\s+(?P<name>{ID})", _block("class", meta=_mods(_JAVA_LEVELS))),
    _rule(rf"{_JAVA_MODS}interface\s+(?P<name>{ID})", _block("interface", meta=_mods(_JAVA_LEVELS))),
    _rule(rf"{_JAVA_MODS}@interface\s+(?P<name>{ID})", _block("annotation", meta=_mods(_JAVA_LEVELS))),
    _rule(rf"{_JAVA_MODS}enum\s+(?P<name>{ID})", _enum(meta=_mods(_JAVA_LEVELS))),
    _rule(rf"{_JAVA_MODS}(?P<tp>{GEN}\s*)?(?P<type>{_TYPE})\s+(?P<name>{ID})\s*(?=\()", _member_function(_JAVA_LEVELS, _java_parameters), "class", "interface", "enum"),
    _rule(rf"{_JAVA_MODS}(?P<tp>{GEN}\s*)?(?P<name>{ID})\s*(?=\()", _member_function(_JAVA_LEVELS, _java_parameters), "class", "enum"),
    _rule(rf"{_JAVA_MODS}(?P<type>{_TYPE})\s+(?P<name>{ID})\s*(?=[=;,\[])", _member_field(_JAVA_LEVELS), "class", "enum"),
), doc_style="javadoc")

_CS_LEVELS = ("public", "private", "protected", "internal")
_CS_MODS = r"(?P<mods>(?:(?:\[[^\]]*\]\s*|(?:public|private|protected|internal|static|abstract|sealed|virtual|override|readonly|const|async|partial|extern|unsafe|new|volatile|required|file)\s+))*)"


def _cs_property(s: Scanner, m: re.Match, where: str) -> int:
    at = m.end()
    if s.mask[at] == "{":
        end = s.close(at) + 1
        tail = _rx(r"\s*=(?!>)").match(s.mask, end)
        if tail:
            end = s.until(tail.end(), len(s.mask), ";") + 1
    else:
        end = min(s.until(at, len(s.mask), ";") + 1, len(s.mask))
    return s.add("property", m["name"], m.start(), end, _modifiers(m, _CS_LEVELS) | {"dataType": s.source(*m.span("type"))}, None, "", m.start("name"))


CSHARP = Language("csharp", (
    _rule(r"namespace\s+(?P<name>[\w.]+)\s*(?=\{)", _block("namespace")),
    _rule(r"namespace\s+(?P<name>[\w.]+)(?=\s*;)", _line("namespace")),
    _rule(rf"{_CS_MODS}class\s+(?P<name>{ID})", _block("class", meta=_mods(_CS_LEVELS))),
    _rule(rf"{_CS_MODS}(?:ref\s+)?struct\s+(?P<name>{ID})", _block("struct", meta=_mods(_CS_LEVELS))),
    _rule(rf"{_CS_MODS}interface\s+(?P<name>{ID})", _block("interface", meta=_mods(_CS_LEVELS))),
    _rule(rf"{_CS_MODS}enum\s+(?P<name>{ID})", _enum(meta=_mods(_CS_LEVELS))),
    _rule(rf"{_CS_MODS}(?P<type>{_TYPE})\s+(?P<name>{ID})\s*(?P<tp2>{GEN})?\s*(?=\()", _member_function(_CS_LEVELS, _cs_parameters), "class", "struct", "interface"),
    _rule(rf"{_CS_MODS}(?P<name>{ID})\s*(?=\()", _member_function(_CS_LEVELS, _cs_parameters), "class", "struct"),
    _rule(rf"{_CS_MODS}(?P<type>{_TYPE})\s+(?P<name>{ID})\s*(?=\{{|=>)", _cs_property, "class", "struct", "interface"),
    _rule(rf"{_CS_MODS}(?P<type>{_TYPE})\s+(?P<name>{ID})\s*(?=[=;,])", _member_field(_CS_LEVELS), "class", "struct"),
), noise=_rx(r"@\"(?:\"\"|[^\"])*\"|" + C_NOISE), doc_style="xmldoc")


# C++

_CPP_PRE = rf"(?P<mods>(?:(?:template\s*{GEN}|virtual|static|inline|explicit|constexpr|friend|extern|mutable|typename)\s+|\[\[[^\]]*\]\]\s*)*)"
_CPP_TYPE = rf"(?!(?:return|else|new|delete|using|typedef|namespace|class|struct|union|enum|case|goto|throw|public|private|protected|operator|template)\b)(?:(?:const|unsigned|signed|long|short)\s+)*{ID}(?:\s*::\s*{ID})*\s*(?:{GEN})?(?:\s*::\s*{ID})*(?:\s+const)?"


def _cpp_visibility(s: Scanner) -> str | None:
    if s.access and s.access[-1]:
        return s.access[-1]
    kinds = [s.defs[i].kind for i in reversed(s.open)]
    return next(("public" if k == "struct" else "private" for k in kinds if k in ("struct", "class")), None)


def _cpp_access(s: Scanner, m: re.Match, where: str) -> int:
    s.access[-1] = m["name"]
    return m.end()


def _cpp_function(s: Scanner, m: re.Match, where: str) -> int | None:
    kind = m.groupdict().get("type")
    if not kind and (where not in ("class", "struct") or not s.open or m["name"] != s.defs[s.open[-1]].name):
        if not (m["name"].count("::") and m["name"].split("::")[-1] == m["name"].split("::")[-2]):
            return None
    close = s.close(m.end())
    at = s.until(close + 1, len(s.mask), "{;")
    if kind and where == "block":
        return None
    words = (m["mods"] or "").split()
    shown = re.sub(r"^const\s+|\s+const$", "", s.source(*m.span("type"))) if kind else None
    meta = {"visibility": _cpp_visibility(s), "isStatic": True if "static" in words else None, "isVirtual": True if "virtual" in words else None, "parameters": _cpp_parameters(s, m.end() + 1, close), "returnType": shown}
    start = m.start() + (re.match(rf"template\s*{GEN}\s*", s.mask[m.start() : m.end()]) or re.match("", "")).end()
    if at < len(s.mask) and s.mask[at] == "{":
        end = s.close(at)
        return s.add("function", m["name"].replace(" ", ""), start, end + 1, meta, (at + 1, end, "block"), "", m.start("name"))
    return s.add("function", m["name"].replace(" ", ""), start, min(at + 1, len(s.mask)), meta, None, "", m.start("name"))


def _cpp_field(s: Scanner, m: re.Match, where: str) -> int:
    at = s.until(m.end(), len(s.mask), ";")
    meta = {"visibility": _cpp_visibility(s), "isStatic": True if "static" in (m["mods"] or "").split() else None, "dataType": re.sub(r"^const\s+|\s+const$", "", s.source(*m.span("type")))}
    return s.add("field", m["name"], m.start(), min(at + 1, len(s.mask)), meta, None, "", m.start("name"))


def _cpp_type(kind: str):
    make = _block(kind, {"union": "struct", "enum": "values"}.get(kind, kind))

    def typed(s: Scanner, m: re.Match, where: str) -> int | None:
        at = s.until(m.end(), len(s.mask), "{;()=,")
        return make(s, m, where) if at < len(s.mask) and s.mask[at] == "{" else None

    return typed


_CPP_NAME = rf"(?P<name>{ID}(?:\s*::\s*~?{ID})*)"
CPP = Language("cpp", (
    Rule(re.compile(r"#\s*include\s*(?P<name><[^>\n]*>|\"[^\"\n]*\")"), lambda s, m, w: s.add("include", s.source(*m.span("name")), m.start(), m.end()), None),
    Rule(re.compile(r"#[^\n]*(?:\\\n[^\n]*)*"), lambda s, m, w: m.end(), None),
    _rule(r"(?P<name>public|private|protected)\s*:(?!:)", _cpp_access, "class", "struct"),
    _rule(rf"(?:inline\s+)?namespace\s+(?P<name>{ID})\s*(?=\{{)", _block("namespace")),
    _rule(rf"(?:template\s*{GEN}\s*)?class\s+(?:\[\[[^\]]*\]\]\s*)?(?P<name>{ID})", _cpp_type("class")),
    _rule(rf"(?:template\s*{GEN}\s*)?(?:typedef\s+)?struct\s+(?P<name>{ID})", _cpp_type("struct")),
    _rule(rf"(?:typedef\s+)?union\s+(?P<name>{ID})", _cpp_type("union")),
    _rule(rf"enum\s+(?:class\s+|struct\s+)?(?P<name>{ID})", _cpp_type("enum")),
    _rule(rf"{_CPP_PRE}(?P<type>{_CPP_TYPE})\s+{_CPP_NAME}\s*(?=\()", _cpp_function, "top", "namespace", "class", "struct"),
    _rule(rf"{_CPP_PRE}{_CPP_NAME}\s*(?=\()", _cpp_function, "top", "namespace", "class", "struct"),
    _rule(rf"{_CPP_PRE}(?P<type>{_CPP_TYPE})\s+(?P<name>{ID})\s*(?=[=;{{])", _cpp_field, "class", "struct"),
))


# Go


def _go_visibility(name: str) -> str:
    c = name[:1]
    return "public" if c and c == c.upper() != c.lower() else "private"


def _go_parameters(s: Scanner, a: int, b: int) -> list[dict]:
    """An entry for each declaration; of names that share a type the first one."""
    out: list[dict] = []
    pending: str | None = None
    parts = s.split(a, b)
    typed = [bool(re.match(rf"\s*{ID}\s+\S", s.mask[i:j])) for i, j in parts]
    for (i, j), has in zip(parts, typed):
        text = s.source(i, j)
        if not any(typed):
            out.append({"name": "", "type": text})
        elif not has:
            pending = pending or text
        else:
            name, kind = text.split(None, 1)
            if not kind.startswith("..."):  # a variadic declaration is another kind of node
                out.append({"name": pending or name, "type": kind})
            pending = None
    return out


def _go_result(s: Scanner, at: int) -> tuple[str | None, int]:
    m = re.compile(r"[^\S\n]*").match(s.mask, at)
    i = first = m.end()
    while i < len(s.mask) and s.mask[i] not in "{}\n;":
        i = s.close(i) + 1 if s.mask[i] in "([" else i + 1
        if s.mask[first:i].endswith(("interface", "struct")) and s.mask[i : i + 1] == "{":
            i = s.close(i) + 1
    return s.source(first, i) or None, i


def _go_func(s: Scanner, m: re.Match, where: str) -> int:
    at = m.end()
    close = s.close(at)
    result, end = _go_result(s, close + 1)
    receiver = s.source(*m.span("receiver")) if m["receiver"] else None
    meta = {"visibility": _go_visibility(m["name"]), "parameters": _go_parameters(s, at + 1, close), "returnType": result, "receiver": receiver}
    body = None
    if end < len(s.mask) and s.mask[end] == "{":
        body = (end + 1, s.close(end), "block")
        end = body[1] + 1
    return s.add("method" if receiver else "function", m["name"], m.start(), end, meta, body, "", m.start("name"))


def _go_type(s: Scanner, m: re.Match, where: str) -> int | None:
    if m["group"]:
        close = s.close(m.end() - 1)
        s.walk(m.end(), close, "types")
        return close + 1
    return _go_spec(s, m, where)


def _go_spec(s: Scanner, m: re.Match, where: str) -> int | None:
    kind, at = m["kind"], m.end() - 1
    close = s.close(at)
    return s.add(kind, m["name"], m.start("name"), close + 1, {"visibility": _go_visibility(m["name"])}, (at + 1, close, kind), "", m.start("name"))


def _go_field(s: Scanner, m: re.Match, where: str) -> int:
    end = m.end()
    kind = re.sub(r"\s*(?:`.*`|\"(?:\\.|[^\"\\])*\")\s*$", "", s.source(*m.span("type")))
    if kind.startswith("struct") and "{" in s.mask[m.start() : m.end()]:
        at = s.mask.find("{", m.start())
        close = s.close(at)
        return s.add("field", m["name"], m.start(), close + 1, {"visibility": _go_visibility(m["name"]), "dataType": s.source(m.start("type"), close + 1)}, (at + 1, close, "struct"))
    return s.add("field", m["name"], m.start(), end, {"visibility": _go_visibility(m["name"]), "dataType": kind})


def _go_method(s: Scanner, m: re.Match, where: str) -> int:
    close = s.close(m.end())
    result, end = _go_result(s, close + 1)
    return s.add("method", m["name"], m.start(), end, {"visibility": _go_visibility(m["name"]), "parameters": _go_parameters(s, m.end() + 1, close), "returnType": result})


def _go_const(s: Scanner, m: re.Match, where: str) -> int:
    end = s.close(m.start("group")) + 1 if m["group"] else s.until(m.end(), len(s.mask), "\n;")
    return s.add("constant", m["name"], m.start(), end, None, None, "", m.start("name"))


GO = Language("go", (
    _rule(rf"func\s+(?P<receiver>\([^()]*\)\s*)?(?P<name>{ID})\s*(?:\[[^\]]*\]\s*)?(?=\()", _go_func, "top"),
    _rule(rf"type\s+(?:(?P<group>\()|(?P<name>{ID})\s*(?:\[[^\]]*\]\s*)?(?P<kind>struct|interface)\s*\{{)", _go_type),
    _rule(rf"(?P<name>{ID})\s*(?:\[[^\]]*\]\s*)?(?P<kind>struct|interface)\s*\{{", _go_spec, "types"),
    _rule(rf"const\s*(?:(?P<group>\()\s*)?(?P<name>{ID})", _go_const),
    _rule(rf"(?P<name>{ID})(?:\s*,\s*{ID})*[^\S\n]+(?P<type>[^\n;}}]+)", _go_field, "struct"),
    _rule(rf"(?P<name>{ID})(?=\()", _go_method, "interface"),
), noise=_rx(C_NOISE + r"|`[^`]*`"), newline=True)


# Rust

_RUST_PUB = r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?"
_RUST_LEAD = _rx(r"(?:#!?\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)*")


def _rust_pub(s: Scanner, m: re.Match) -> dict:
    return {"visibility": "public" if m["pub"] else None}


def _rust_fn(s: Scanner, m: re.Match, where: str) -> int:
    close = s.close(m.end())
    params = []
    for i, j in s.split(m.end() + 1, close):
        text = s.source(i, j)
        colon = next((c for c, _ in _marks(s, i, j, ":") if s.mask[c + 1 : c + 2] != ":" and s.mask[c - 1] != ":"), -1)
        if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", text):
            params.append({"name": text})
        elif colon >= 0:
            params.append({"name": re.sub(r"^mut\s+", "", s.source(i, colon)), "type": s.source(colon + 1, j)})
    arrow = _rx(r"\s*->\s*").match(s.mask, close + 1)
    at = s.until(close + 1, len(s.mask), "{;")
    clause = _rx(r"\bwhere\b").search(s.mask, close, at)
    ret = s.source(arrow.end(), clause.start() if clause else at) if arrow else None
    meta = _rust_pub(s, m) | {"parameters": params, "returnType": ret}
    if at < len(s.mask) and s.mask[at] == "{":
        end = s.close(at)
        return s.add("function", m["name"], m.start(), end + 1, meta, (at + 1, end, "block"), "", m.start("name"))
    return s.add("function", m["name"], m.start(), min(at + 1, len(s.mask)), meta, None, "", m.start("name"))


def _rust_field(s: Scanner, m: re.Match, where: str) -> int:
    end, depth = m.end(), 0
    while end < len(s.mask) and not (s.mask[end] in ",}" and not depth):
        c = s.mask[end]
        if c in "([{":
            end = s.close(end)
        depth += (c == "<") - (c == ">" and s.mask[end - 1] != "-")
        end += 1
    return s.add("field", m["name"], m.start(), end, _rust_pub(s, m) | {"dataType": s.source(m.end(), end)}, None, "", m.start("name"))


RUST = Language("rust", (
    _rule(rf"{_RUST_PUB}struct\s+(?P<name>{ID})", _block("struct", meta=_rust_pub)),
    _rule(rf"{_RUST_PUB}enum\s+(?P<name>{ID})", _enum(meta=_rust_pub, nested="struct")),
    _rule(rf"{_RUST_PUB}(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<name>{ID})", _block("trait", meta=_rust_pub)),
    _rule(rf"(?:unsafe\s+)?impl\s*(?:{GEN}\s*)?(?:!?[\w:]+\s*(?:{GEN})?\s+for\s+)?(?P<name>{ID})\s*(?=\{{|where\b)", _block("impl")),
    _rule(rf"{_RUST_PUB}mod\s+(?P<name>{ID})", _block("module")),
    _rule(rf"{_RUST_PUB}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>{ID})\s*(?:{GEN})?\s*(?=\()", _rust_fn),
    _rule(rf"{_RUST_PUB}const\s+(?P<name>{ID})\s*:", _line("constant")),
    _rule(rf"{_RUST_PUB}(?P<name>{ID})\s*:(?!:)", _rust_field, "struct"),
), frozenset(("impl", "trait")), noise=_rx(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\[^']*|[^'\\\n])'"), lead=_RUST_LEAD)


# PHP

_PHP_MODS = r"(?P<mods>(?:(?:public|private|protected|static|abstract|final|readonly|var)\s+)*)"
_PHP_TYPE = r"(?P<type>\??[\w\\|&]+)"


def _php_parameters(s: Scanner, a: int, b: int) -> list[dict]:
    out = []
    for i, j in s.split(a, b):
        m = re.match(r"\s*(?:#\[[^\]]*\]\s*)*(?P<promoted>(?:(?:public|private|protected|readonly)\s+)*)(?P<type>\??[\w\\|&]+\s+)?(?P<by>&\s*)?(?:\.\.\.\s*)?(?P<name>\$\w+)\s*(?P<default>=)?", s.mask[i:j])
        if not m or m["promoted"]:
            continue
        p = {"name": m["name"]} | ({"type": m["type"].strip()} if m["type"] else {})
        if m["default"]:
            p |= {"optional": True, "defaultValue": s.source(i + m.end("default"), j)}
        out.append(p)
    return out


def _php_function(s: Scanner, m: re.Match, where: str) -> int:
    close = s.close(m.end())
    ret = _rx(rf"\s*:\s*{_PHP_TYPE}").match(s.mask, close + 1)
    at = s.until(close + 1, len(s.mask), "{;")
    words = (m["mods"] or "").split()
    meta = {"visibility": next((v for v in words if v in ("public", "private", "protected")), None), "isStatic": True if "static" in words else None, "isAbstract": True if "abstract" in words else None, "parameters": _php_parameters(s, m.end() + 1, close), "returnType": ret["type"] if ret else None}
    if at < len(s.mask) and s.mask[at] == "{":
        end = s.close(at)
        return s.add("function", m["name"], m.start(), end + 1, meta, (at + 1, end, "block"), "", m.start("name"))
    return s.add("function", m["name"], m.start(), min(at + 1, len(s.mask)), meta, None, "", m.start("name"))


def _php_property(s: Scanner, m: re.Match, where: str) -> int:
    words = m["mods"].split()
    end = min(s.until(m.end(), len(s.mask), ";") + 1, len(s.mask))
    return s.add("property", m["name"], m.start(), end, {"visibility": next((v for v in words if v in ("public", "private", "protected")), None), "isStatic": True if "static" in words else None, "dataType": m["type"].strip() if m["type"] else None})


def _php_modifiers(s: Scanner, m: re.Match) -> dict:
    return {"isAbstract": True if "abstract" in (m["mods"] or "").split() else None}


PHP = Language("php", (
    Rule(re.compile(r"<\?(?:php|=)?|\?>"), lambda s, m, w: m.end(), None),
    _rule(r"namespace\s+(?P<name>[\w\\]+)\s*(?=\{)", _block("namespace")),
    _rule(r"namespace\s+(?P<name>[\w\\]+)(?=\s*;)", _line("namespace")),
    _rule(rf"interface\s+(?P<name>{ID})", _block("interface")),
    _rule(rf"(?P<mods>(?:(?:abstract|final|readonly)\s+)*)class\s+(?P<name>{ID})", _block("class")),
    _rule(rf"trait\s+(?P<name>{ID})", _block("trait")),
    _rule(rf"{_PHP_MODS}function\s+&?\s*(?P<name>{ID})\s*(?=\()", _php_function),
    _rule(rf"(?P<mods>(?:(?:public|private|protected|static|readonly|var)\s+)+)(?P<type>\??[\w\\|&]+\s+)?\$(?P<name>{ID})", _php_property, "class", "trait"),
), frozenset(("class", "interface", "trait")), noise=_rx(C_NOISE + r"|#(?!\[)[^\n]*"), comment="/#", lead=_rx(r"(?:#\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)*"))


# Kotlin, Swift and Scala

_KT_MODS = r"(?P<mods>(?:(?:@[\w.]+(?:\([^()]*\))?|public|private|protected|internal|abstract|open|final|override|data|sealed|inner|enum|annotation|inline|infix|operator|suspend|tailrec|external|lateinit|const|value|fun(?=\s+interface)|companion|expect|actual|vararg)\s+)*)"
_kt_parameters = _named_types("vararg crossinline noinline")


def _kt_mods(s: Scanner, m: re.Match) -> dict:
    words = _words(m)
    return {"visibility": next((v for v in words if v in ("public", "private", "protected", "internal")), None), "isAbstract": True if "abstract" in words else None}


def _typed_function(parameters: Callable, meta: Callable, arrow: str, kind: str = "function", static: bool = False):
    """A function whose result follows ``arrow`` and whose body is a block or an expression."""

    def make(s: Scanner, m: re.Match, where: str) -> int:
        head = m.end()
        close = s.close(head) if head < len(s.mask) and s.mask[head] == "(" else head - 1
        params = parameters(s, head + 1, close) if close >= head else []
        after = close + 1
        while s.language.name == "scala" and (more := _rx(r"\s*\(").match(s.mask, after)):
            after = s.close(more.end() - 1) + 1
        result = _rx(rf"\s*(?:(?:throws|rethrows|async)\s+)*{arrow}\s*").match(s.mask, after)
        end = first = result.end() if result else after
        while end < len(s.mask) and s.mask[end] not in "{\n;}" and not (s.mask[end] == "=" and s.mask[end + 1] != ">"):
            end = s.close(end) + 1 if s.mask[end] in "([" else end + 1
        text = re.sub(r"\s+where\b.*", "", s.source(first, end), flags=re.S) if result else None
        info = meta(s, m) | {"parameters": params, "returnType": (text if s.language.name == "scala" else _user_type(text)) if text else None}
        tail = _rx(r"\s*(?:=\s*)?(?:where\b[^{\n]*)?\{").match(s.mask, end)
        name = m["name"]
        if tail:
            at = tail.end() - 1
            stop = s.close(at)
            return s.add(kind, name, m.start(), stop + 1, info, (at + 1, stop, "block"), "", m.start("name"))
        if end < len(s.mask) and s.mask[end] == "=":
            value = _rx(r"=\s*").match(s.mask, end).end()
            stop = value
            while stop < len(s.mask) and s.mask[stop] not in "\n;}":
                if s.mask[stop] == "{":
                    s.blocks(stop, s.close(stop) + 1)
                stop = s.close(stop) + 1 if s.mask[stop] in "([{" else stop + 1
            end = stop
        return s.add(kind, name, m.start(), max(end, after), info, None, "", m.start("name"))

    return make


def _kt_class(s: Scanner, m: re.Match, where: str) -> int | None:
    at = m.end()
    if at < len(s.mask) and (paren := _rx(r"\s*(?:@\w+\s*|(?:private|internal|protected|public)\s+)*(?:constructor\s*)?\(").match(s.mask, at)):
        at = s.close(paren.end() - 1) + 1
    end = s.until(at, len(s.mask), "{\n;}")
    while end < len(s.mask) and s.mask[end] == "\n" and re.match(r"\s*(?::|where\b|\{)", s.mask[end:]) or end < len(s.mask) and s.mask[end] == "\n" and s.mask[at:end].rstrip().endswith((":", ",")):
        end = s.until(end + 1, len(s.mask), "{\n;}")
    meta, kind = (_kt_mods(s, m) if m["kind"] != "object" else None), "object" if m["kind"] == "object" else "class"
    shown = "interface" if m["kind"] == "interface" else ""
    if end < len(s.mask) and s.mask[end] == "{":
        close = s.close(end)
        return s.add(kind, m["name"], m.start(), close + 1, meta, (end + 1, close, kind), shown, m.start("name"))
    return s.add(kind, m["name"], m.start(), end, meta, None, shown, m.start("name"))


def _kt_property(s: Scanner, m: re.Match, where: str) -> int:
    end = s.until(m.end(), len(s.mask), "\n;}{")
    if end < len(s.mask) and s.mask[end] == "{":
        s.blocks(end, s.close(end) + 1)
        end = s.close(end) + 1
    return s.add("property", m["name"], m.start(), end, _kt_mods(s, m), None, "", m.start("name"))


KOTLIN = Language("kotlin", (
    _rule(rf"{_KT_MODS}(?P<kind>class|interface|object)\s+(?P<name>{ID})(?:\s*{GEN})?", _kt_class),
    _rule(rf"{_KT_MODS}fun\s+(?:{GEN}\s*)?(?:[\w.?<>, ]+\.)?(?P<name>{ID})\s*(?=\()", _typed_function(_kt_parameters, _kt_mods, ":")),
    _rule(rf"{_KT_MODS}va[lr]\s+(?:{GEN}\s*)?(?:{ID}\.)?(?P<name>{ID})", _kt_property),
), frozenset(("class", "interface", "object")), noise=_rx(r"\"\"\".*?\"\"\"|" + C_NOISE), newline=True)

_SWIFT_MODS = r"(?P<mods>(?:(?:@\w+(?:\([^()]*\))?|public|private|fileprivate|internal|open|package|static|class(?=\s+(?:func|var|let))|final|override|mutating|nonmutating|lazy|weak|unowned|required|convenience|dynamic|indirect|async|nonisolated)(?:\s*\(set\))?\s+)*)"
_swift_parameters = _named_types("")


def _swift_mods(s: Scanner, m: re.Match) -> dict:
    words = _words(m)
    return {"visibility": next((v for v in words if v in ("public", "private", "fileprivate", "internal", "open", "package")), None), "isStatic": True if "static" in words else None}


def _swift_type(s: Scanner, m: re.Match, where: str) -> int | None:
    at = s.until(m.end(), len(s.mask), "{;")
    if at >= len(s.mask) or s.mask[at] != "{":
        return None
    close = s.close(at)
    kind = "protocol" if m["kind"] == "protocol" else "class"
    return s.add(kind, m["name"], m.start(), close + 1, None, (at + 1, close, m["kind"]), m["kind"], m.start("name"))


def _swift_property(s: Scanner, m: re.Match, where: str) -> int | None:
    if where == "protocol":
        return s.until(m.end(), len(s.mask), "\n;") + 1
    end = s.until(m.end(), len(s.mask), "\n;{}")
    equals = next((e for e, _ in _marks(s, m.end(), end, "=")), -1)
    colon = _rx(r"\s*:\s*").match(s.mask, m.end())
    kind = _user_type(s.source(colon.end(), equals if equals >= 0 else end)) if colon else None
    if end < len(s.mask) and s.mask[end] == "{":
        s.blocks(end, s.close(end) + 1)
        end = s.close(end) + 1
    return s.add("property", m["name"], m.start(), end, {"dataType": kind}, None, "", m.start("name"))


SWIFT = Language("swift", (
    _rule(rf"{_SWIFT_MODS}(?P<kind>class|struct|enum|actor|protocol)\s+(?P<name>{ID})", _swift_type),
    _rule(rf"{_SWIFT_MODS}(?P<kind>extension)\s+(?P<name>{ID})", _swift_type),
    _rule(rf"{_SWIFT_MODS}func\s+(?P<name>{ID})\s*(?:{GEN})?\s*(?=\()", _typed_function(_swift_parameters, _swift_mods, "->")),
    _rule(rf"{_SWIFT_MODS}(?P<name>init)[?!]?\s*(?:{GEN})?\s*(?=\()", _typed_function(_swift_parameters, _swift_mods, "->"), "class", "struct", "enum", "actor", "protocol", "extension"),
    _rule(rf"(?:indirect\s+)?case\s+(?P<name>{ID})", _line("enum-value"), "enum"),
    _rule(rf"{_SWIFT_MODS}(?:var|let)\s+(?P<name>{ID})", _swift_property),
), frozenset(("class", "protocol")), noise=_rx(r"\"\"\".*?\"\"\"|" + C_NOISE), newline=True)

_SCALA_MODS = r"(?P<mods>(?:(?:@\w+(?:\([^()]*\))?|(?:private|protected)(?:\[\w+\])?|abstract|final|sealed|implicit|lazy|override|case|inline|transparent|open)\s+)*)"


def _scala_meta(s: Scanner, m: re.Match) -> dict:
    v = re.search(r"(?:private|protected)(?:\[\w+\])?", m["mods"] or "")
    return {"visibility": v[0] if v else None}


def _scala_type(kind: str):
    def make(s: Scanner, m: re.Match, where: str) -> int:
        at = m.end()
        while more := _rx(r"\s*(?:\[[^\]]*\]\s*)?(?:(?:private|protected)\s*)?(?:implicit\s+)?\(").match(s.mask, at):
            at = s.close(more.end() - 1) + 1
        end = s.until(at, len(s.mask), "{\n;}")
        while end < len(s.mask) and s.mask[end] == "\n" and re.match(r"\s*(?:extends|with|\{)", s.mask[end:]):
            end = s.until(end + 1, len(s.mask), "{\n;}")
        if end < len(s.mask) and s.mask[end] == "{":
            close = s.close(end)
            return s.add(kind, m["name"], m.start(), close + 1, None, (end + 1, close, kind), "", m.start("name"))
        return s.add(kind, m["name"], m.start(), end, None, None, "", m.start("name"))

    return make


SCALA = Language("scala", (
    _rule(rf"{_SCALA_MODS}class\s+(?P<name>{ID})", _scala_type("class")),
    _rule(rf"{_SCALA_MODS}object\s+(?P<name>{ID})", _scala_type("object")),
    _rule(rf"{_SCALA_MODS}trait\s+(?P<name>{ID})", _scala_type("trait")),
    _rule(rf"{_SCALA_MODS}def\s+(?P<name>{ID})\s*(?:\[[^\]]*\])?\s*(?=\(|)", _typed_function(_named_types("implicit using val var inline", user_types=False), _scala_meta, ":")),
), frozenset(("class", "object", "trait")), noise=_rx(r"\"\"\".*?\"\"\"|//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^']+|[^'\\\n])'"), newline=True)

BY_EXTENSION = {"ts": TYPESCRIPT, "tsx": TYPESCRIPT, "js": JAVASCRIPT, "jsx": JAVASCRIPT, "java": JAVA, "cs": CSHARP, "cpp": CPP, "go": GO, "rs": RUST, "php": PHP, "phtml": PHP, "kt": KOTLIN, "kts": KOTLIN, "swift": SWIFT, "scala": SCALA, "sbt": SCALA}
