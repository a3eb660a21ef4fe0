"""A scanner for source code with brackets.

Strings and comments are blanked out at their places, brackets are paired, and declarations are
matched by a language's rules where a statement or member can start.  It reads broken code as far
as it can.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

ID = r"[^\W\d][\w$]*"
GEN = r"<[^<>;{}]*(?:<[^<>;{}]*(?:<[^<>;{}]*>[^<>;{}]*)*>[^<>;{}]*)*>"
C_NOISE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_BRACKETS = re.compile(r"[(){}\[\]]")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_STOP = re.compile(r"[;{}()\[\]\n]")


@dataclass
class Definition:
    """A definition: its place, capture kind, outline type, name and metadata."""

    start: int
    end: int
    kind: str
    name: str
    parent: int | None
    meta: dict = field(default_factory=dict)
    type: str = ""
    exported: bool = False
    anchor: int = 0
    name_at: int = -1
    docstring: str | None = None


@dataclass(frozen=True)
class Rule:
    """``match`` at the start of a statement within ``where`` (None: anywhere) calls ``make``, which
    returns where to go on, or None if it is no such declaration after all."""

    match: re.Pattern
    make: Callable[["Scanner", re.Match, str], int | None]
    where: frozenset[str] | None = None


@dataclass(frozen=True)
class Language:
    name: str
    rules: tuple[Rule, ...]
    class_like: frozenset[str] = frozenset(("class", "struct", "interface"))
    noise: re.Pattern = re.compile(C_NOISE, re.S)
    comment: str = "/"
    newline: bool = False
    doc_style: str = "jsdoc"
    lead: re.Pattern | None = None


class Scanner:
    def __init__(self, text: str, language: Language):
        self.text, self.language = text, language
        self.comments: list[tuple[int, int]] = []
        self.mask = language.noise.sub(self._blank, text)
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for m in _BRACKETS.finditer(self.mask):
            c = m[0]
            if c in "([{":
                stack.append(m.start())
            elif stack and self.mask[stack[-1]] == _CLOSERS[c]:
                self.pair[stack.pop()] = m.start()
            elif c == "}":  # drop brackets left open within a block
                while stack and self.mask[stack[-1]] != "{":
                    stack.pop()
                if stack:
                    self.pair[stack.pop()] = m.start()
        for i in stack:
            self.pair[i] = len(text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.defs: list[Definition] = []
        self.open: list[int] = []
        self.export_at = -1
        self.exported = False
        self.access: list[str | None] = []

    def _blank(self, m: re.Match) -> str:
        t = m[0]
        if t[0] in self.language.comment and not (t[0] == "/" and t[:2] not in ("//", "/*")) and not (t[0] == "-" and t[:2] != "--"):
            self.comments.append((m.start(), m.end()))
            return re.sub(r"[^\n]", " ", t)
        return t[0] + re.sub(r"[^\n]", "_", t[1:-1]) + t[-1] if len(t) > 1 else t

    def scan(self) -> list[Definition]:
        self.walk(0, len(self.mask), "top")
        like = self.language.class_like
        for d in self.defs:
            inside = d.parent is not None and self.defs[d.parent].kind in like
            d.type = d.type or ("method" if d.kind == "function" and inside else d.kind)
        return self.defs

    def walk(self, at: int, end: int, where: str) -> None:
        rules, lead = self.language.rules, self.language.lead
        while at < end:
            while at < end and (self.mask[at].isspace() or self.mask[at] in ";,"):
                at += 1
            if at >= end:
                return
            start = at
            self.exported, self.export_at = False, at
            if lead and (m := lead.match(self.mask, at, end)):
                self.exported = bool(m.groupdict().get("export"))
                at = m.end()
            for rule in rules:
                if rule.where is not None and where not in rule.where:
                    continue
                m = rule.match.match(self.mask, at, end)
                if m:
                    after = rule.make(self, m, where)
                    if after is not None:
                        at = max(after, at + 1)
                        break
            else:
                at = max(self.skip(at, end), start + 1)

    def skip(self, at: int, end: int) -> int:
        """The end of a statement that no rule takes; blocks in it are walked."""
        while m := _STOP.search(self.mask, at, end):
            c, at = m[0], m.start()
            if c == "{":
                close = min(self.pair[at], end)
                self.walk(at + 1, close, "block")
                return close + 1
            if c in "([":
                close = min(self.pair.get(at, at), end)
                self.blocks(at + 1, close)
                at = close + 1
                continue
            if c == ";" or c == "\n" and self.language.newline or c in ")]}":
                return at + 1
            at += 1
        return end

    def blocks(self, at: int, end: int) -> None:
        """Walk the outermost blocks between two places."""
        while 0 <= (at := self.mask.find("{", at, end)) < end:
            close = min(self.pair[at], end)
            self.walk(at + 1, close, "block")
            at = close + 1

    def until(self, at: int, end: int, stops: str) -> int:
        """The first of ``stops`` outside of round and square brackets."""
        wanted = re.compile("[" + re.escape(stops + "([") + "]")
        while m := wanted.search(self.mask, at, end):
            if m[0] in stops:
                return m.start()
            at = self.pair.get(m.start(), m.start()) + 1
        return end

    def close(self, at: int) -> int:
        return min(self.pair.get(at, at), len(self.text))

    def add(self, kind: str, name: str, start: int, end: int, meta: dict | None = None, body: tuple[int, int, str] | None = None, type: str = "", name_at: int = -1) -> int:
        """Record a definition, walk its body as the named place, and return its end."""
        d = Definition(start, end, kind, name, self.open[-1] if self.open else None, {k: v for k, v in (meta or {}).items() if v is not None}, type, self.exported, self.export_at if self.exported else start, name_at)
        self.defs.append(d)
        if body:
            self.open.append(len(self.defs) - 1)
            self.access.append(None)
            self.walk(*body)
            self.access.pop()
            self.open.pop()
        return end

    def source(self, a: int, b: int) -> str:
        return self.text[a:b].strip()

    def split(self, a: int, b: int, mark: str = ",") -> list[tuple[int, int]]:
        """Places of the parts between top-level marks; brackets of all kinds, <> too, hold together."""
        out, first, at, angle = [], a, a, 0
        while at < b:
            c = self.mask[at]
            if c in "([{":
                at = min(self.pair.get(at, at), b)
            elif c == "<":
                angle += 1
            elif c == ">" and self.mask[at - 1] not in "=-":
                angle = max(0, angle - 1)
            elif c == mark and not angle:
                out.append((first, at))
                first = at + 1
            at += 1
        out.append((first, b))
        return [(i, j) for i, j in out if self.mask[i:j].strip()]

    def find(self, a: int, b: int, mark: str) -> int:
        """Where a top-level mark is between two places, or -1."""
        parts = self.split(a, b, mark) if mark in self.mask[a:b] else []
        return parts[0][1] if parts and parts[0][1] < b else -1

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def doc(self, d: Definition) -> str | None:
        """The comments right above a definition, cleaned."""
        found, below = [], d.anchor
        for start, end in reversed(self.comments[: bisect.bisect_left(self.comments, (d.anchor, 0))]):
            between = self.text[end:below]
            if between.strip() or between.count("\n") > 1:
                break
            found.insert(0, self.text[start:end])
            below = start
        return clean_comment("\n".join(found)) or None


def clean_comment(text: str) -> str:
    """A comment without its marks: stars and slashes go, # and -- stay."""
    lines = []
    for line in text.split("\n"):
        for mark in (r"^\s*/\*\*?", r"\*/\s*$", r"^\s*///?", r"^\s*\*\s?"):
            line = re.sub(mark, "", line)
        lines.append(line.rstrip())
    return "\n".join(lines).strip()
