"""String functions as Spark expressions, with the semantics of ECMAScript where they differ from Java's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS, NS = f"[{SPACE}]", f"[^{SPACE}]"
#: Any character but a line terminator.
DOT = r"[^\n\r\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def generate_id(title: Column, kind: Column, line: Column) -> Column:
    """``type-title-line``: the title in lower case with - for all but letters and digits; the
    line only if it is there and not 0."""
    slug = F.regexp_replace(F.lower(title), "[^a-z0-9]", "-")
    return F.concat(kind, F.lit("-"), slug, F.when(line.isNotNull() & (line != 0), F.concat(F.lit("-"), line.cast("string"))).otherwise(""))


def anchor(title: Column) -> Column:
    """A link target: lower case, words joined by single hyphens."""
    kept = F.regexp_replace(F.lower(title), rf"[^A-Za-z0-9_{SPACE}-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, f"{WS}+", "-"), "-+", "-")
    return F.regexp_replace(joined, r"^-|-\z", "")


def position(content: Column, index: Column) -> Column:
    """(line, col), both from 1, of a character offset."""
    before = F.substring(content, F.lit(1), index.cast("int"))
    line = F.size(F.split(before, "\n", -1))
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))


def content_hash(content: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(content, 256)


def escape_xml(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_csv(c: Column) -> Column:
    """Quoted, with quotes doubled, where it has a comma, a quote or a line end."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escape_sql(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def sanitize_id(c: Column) -> Column:
    """An identifier for diagrams; ``_`` for an empty title."""
    clean = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), r"^(\d)", "_$1")
    return F.when(clean == "", "_").otherwise(clean)
