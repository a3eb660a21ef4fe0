"""Outlines of INI files and properties, as plans of built-in expressions, and of CSV tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import DOT, WS, generate_id, let, trim
from tessella.operators.lines import explode_lines, split_lines
from tessella.operators.tree import assemble
from tessella.schema import NODE_COLUMNS

_SECTION = rf"^\[({DOT}+?)\]{WS}*\z"
_PAIR = r"(?s)^([^=:]+)[=:](.*)\z"


def ini(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sections of depth 1 and their properties; a property before any section has depth 1.  A
    pair is cut at its first = or :, and one without a key is no property."""
    lines = explode_lines(docs, keep=r"(?s)^[^;#]").withColumn("text", trim(F.col("text"))).where("text <> '' and text not like ';%' and text not like '#%'")
    name = F.regexp_extract("text", _SECTION, 1)
    key, value = trim(F.regexp_extract("text", _PAIR, 1)), trim(F.regexp_extract("text", _PAIR, 2))
    rows = lines.withColumn("name", name).withColumn("key", F.when((name == "") & F.col("text").rlike(_PAIR), key)).where("name <> '' or key is not null")
    section = F.col("name") != ""
    items = rows.select("doc_id", F.col("line").alias("seq"), "line", F.when(section, trim(F.col("name"))).otherwise(F.col("key")).alias("title"), F.when(section, "section").otherwise("property").alias("type"), section.alias("is_section"), F.lit(1).alias("depth"), F.when(~section, F.to_json(F.struct(value.alias("value")))).alias("metadata"))
    return assemble(items, max_depth, levels=1).withColumn("anchor", F.lit(None).cast("string"))


def properties(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Pairs of .properties and .env files, all of depth 1.  A line that ends with a backslash
    goes on in the next, whatever that is; so lines are folded in order, without a shuffle."""
    item = "struct<line:int,text:string>"

    def step(acc, x):
        goes_on = x["t"].rlike(r"\\\z") & ~x["last"]
        bare = trim(x["t"])
        skipped = ~acc["open"] & ((bare == "") | bare.startswith("#") | bare.startswith("!"))
        text = F.concat(F.when(acc["open"], acc["text"]).otherwise(""), F.when(goes_on, F.regexp_replace(x["t"], r"\\\z", "")).otherwise(x["t"]))
        line = F.when(acc["open"], acc["line"]).otherwise(x["i"] + 1).cast("int")
        done = ~skipped & ~goes_on
        return F.struct((~skipped & goes_on).alias("open"), line.alias("line"), text.alias("text"), F.when(done, F.concat(acc["out"], F.array(F.struct(line.alias("line"), text.alias("text"))))).otherwise(acc["out"]).cast(f"array<{item}>").alias("out"))

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("line"), F.lit("").alias("text"), F.array().cast(f"array<{item}>").alias("out"))
    lines = docs.select("doc_id", split_lines(F.col("content")).alias("t"))
    numbered = F.transform("t", lambda t, i: F.struct(i.alias("i"), t.alias("t"), (i == F.size(F.col("t")) - 1).alias("last")))
    rows = lines.select("doc_id", F.explode(F.aggregate(numbered, start, step, lambda a: a["out"])).alias("x")).select("doc_id", "x.line", F.regexp_replace(trim(F.col("x.text")), rf"^export{WS}+", "").alias("text")).where(F.col("text").rlike(_PAIR))
    raw = trim(F.regexp_extract("text", _PAIR, 2))
    value = F.regexp_replace(raw, rf"^(?:\"({DOT}*)\"|'({DOT}*)')\z", "$1$2")
    items = rows.select("doc_id", F.col("line").alias("seq"), "line", trim(F.regexp_extract("text", _PAIR, 1)).alias("title"), F.lit("property").alias("type"), F.lit(True).alias("is_section"), F.lit(1).alias("depth"), F.to_json(F.struct(value.alias("value"))).alias("metadata"))
    return assemble(items, max_depth, levels=1).withColumn("anchor", F.lit(None).cast("string"))


# CSV

DELIMITERS = list(",;\t|:")
_QUOTED_REST = '(?=(?:[^"]*"[^"]*")*[^"]*\\z)'
NUMBER = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\z|^0[xX][0-9a-fA-F]+\z|^0[oO][0-7]+\z|^0[bB][01]+\z"


def _number(text: Column) -> Column:
    """Whether ECMAScript's ``Number`` takes a trimmed text; the empty one is 0."""
    return (text == "") | text.rlike(NUMBER)


def csv_fields(line: Column, delimiter: Column | str) -> Column:
    """The trimmed fields of a line.  A quote opens or closes anywhere, a doubled one within
    quotes stays, and a delimiter counts only outside of quotes: where an even number of quotes
    follows, or, in a line with an open quote, precedes."""
    delimiter = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    # closing an open quote at the end leaves all fields as they are
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    closed = F.when(odd, F.concat(line, F.lit('"'))).otherwise(line)
    pattern = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"), F.lit(_QUOTED_REST))
    parts = F.when(F.contains(line, F.lit('"')), F.split(closed, pattern, F.lit(-1))).otherwise(F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), F.lit(-1)))
    return F.transform(parts, lambda p: trim(_unquoted(p)))


def _unquoted(part: Column) -> Column:
    """A field without its quotes: each opens or closes, but of two in a row within quotes one
    stays.  The field is folded over the pieces between its quotes."""
    return F.when(F.contains(part, F.lit('"')), let(F.split(part, '"', -1), _folded)).otherwise(part)


def _folded(pieces: Column) -> Column:
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda t, i: F.struct(t.alias("t"), (i == F.size(pieces) - 2).alias("last")))

    def step(acc, x):
        pair = acc["open"] & ~acc["second"] & (x["t"] == "") & ~x["last"]
        turn = ~acc["second"] & ~pair
        return F.struct(F.when(turn, ~acc["open"]).otherwise(acc["open"]).alias("open"), pair.alias("second"), F.concat(acc["out"], F.when(pair, F.lit('"')).otherwise(x["t"])).alias("out"))

    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("second"), F.element_at(pieces, 1).alias("out"))
    return F.aggregate(rest, start, step, lambda a: a["out"])


def _field_counts(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda t: F.size(csv_fields(t, delimiter)).cast("double"))


def csv_delimiter(lines: Column) -> Column:
    """The delimiter whose field counts over the first ten lines are most even and many."""
    def score(sizes: Column) -> Column:
        def of_mean(mean: Column) -> Column:
            spread = F.aggregate(F.transform(sizes, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(sizes)
            return F.when(mean > 1, 1 / (1 + spread)).otherwise(0.0) * F.when((mean >= 2) & (mean <= 50), 1.0).otherwise(0.5) * mean

        return let(F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes), of_mean)

    def best(head: Column) -> Column:
        scored = [F.struct(let(_field_counts(head, d), score).alias("score"), F.lit(-i).alias("first"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
        return F.array_max(F.array(*scored))["d"]

    return let(F.slice(lines, 1, 10), best)


def csv_has_header(rows: Column) -> Column:
    """Whether the first row looks like names for the second one's values."""
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    letters = "[A-Za-z]"

    def points(a, b):
        return F.when(~_number(a) & _number(b), 2).otherwise(0) + F.when((F.length(a) > F.length(b)) & (F.length(a) > 3), 1).otherwise(0) + F.when(a.rlike(letters) & ~b.rlike(letters), 1).otherwise(0) - F.when(a == "", 2).otherwise(0)

    total = F.aggregate(F.zip_with(first, second, points), F.lit(0), lambda a, x: a + x)
    return F.coalesce((F.size(rows) >= 2) & (F.size(first) == F.size(second)) & (total > 0), F.lit(False))


def csv_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, delimiter, has_header, rows) of each document with a line that isn't blank."""
    lines = docs.select("doc_id", F.filter(F.transform(split_lines(F.col("content"), False), trim), lambda t: t != "").alias("lines")).where(F.size("lines") > 0)
    cut = lines.withColumn("delimiter", csv_delimiter(F.col("lines")))
    return cut.select("doc_id", "delimiter", F.transform("lines", lambda t: csv_fields(t, F.col("delimiter"))).alias("rows")).withColumn("has_header", csv_has_header(F.col("rows")))


# The same in Python, for the profile: it needs each cell several times, and Spark would make a row of each

_BLANK = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"), re.A)
_LEADING = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", re.A)
_EMAIL = re.compile(r"[^@\s]+@[^@\s]+[.][^@\s]+\Z", re.A)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_NO_HOST = re.compile(r"(?i)(?:https?|ftp|wss?):(?:[/\\]*+(?:[?#]|\Z)|[/\\]*[^/?#]*\s)", re.A)
_DATE = re.compile(r"(?:(?P<y>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})|[0-9]{2}(?P<m>[-/.])[0-9]{2}(?P=m)[0-9]{4})\Z")
_LETTERS = re.compile("[A-Za-z]")
_BOOLEANS = frozenset("0 1 false n no true y yes".split())
_PROFILE = "doc_id string, index int, name string, type string, nullable boolean, unique_values bigint, sample_values array<string>, min_length int, max_length int, avg_length double, min double, max double, columns int"
_PROFILE_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.int32()]


def _fields(line: str, delimiter: str) -> list[str]:
    """``csv_fields`` of one line."""
    if '"' not in line:
        return [p.strip(_BLANK) for p in line.split(delimiter)]
    pieces = (line + '"' if line.count('"') % 2 else line).split('"')
    parts = [""]
    for i, piece in enumerate(pieces):
        first, *more = [piece] if i % 2 else piece.split(delimiter)
        parts[-1] += ('"' if i else "") + first
        parts += more
    return [_bare(p).strip(_BLANK) for p in parts]


def _bare(part: str) -> str:
    out, *rest = part.split('"')
    is_open = second = False
    for i, piece in enumerate(rest):
        pair = is_open and not second and piece == "" and i < len(rest) - 1
        if not second and not pair:
            is_open = not is_open
        out += '"' if pair else piece
        second = pair
    return out


def _delimiter(lines: list[str]) -> str:
    """``csv_delimiter`` of lines."""
    head = lines[:10]

    def score(delimiter: str) -> float:
        sizes = [len(_fields(t, delimiter)) if '"' in t else t.count(delimiter) + 1 for t in head]
        mean = sum(sizes) / len(sizes)
        spread = 0.0
        for x in sizes:
            spread += (x - mean) * (x - mean)
        return (1 / (1 + spread / len(sizes)) if mean > 1 else 0.0) * (1.0 if 2 <= mean <= 50 else 0.5) * mean

    return max(DELIMITERS, key=score)  # the first of equals


def _has_header(rows: list[list[str]]) -> bool:
    """``csv_has_header`` of rows."""
    if len(rows) < 2 or len(rows[0]) != len(rows[1]):
        return False
    number = lambda x: x == "" or bool(_NUMBER.match(x))
    total = 0
    for a, b in zip(rows[0], rows[1]):
        total += 2 * (not number(a) and number(b)) + (len(a) > len(b) and len(a) > 3) + bool(_LETTERS.search(a) and not _LETTERS.search(b)) - 2 * (a == "")
    return total > 0


def _is_date(value: str) -> bool:
    m = _DATE.match(value)
    month, day = (value[5:7], value[8:10]) if m and m["y"] else (value[:2], value[3:5])
    return bool(m) and 1 <= int(month) <= 12 and 1 <= int(day) <= 31


_TYPES: dict[str, Callable[[str], object]] = {
    "email": _EMAIL.match,
    "url": lambda v: _SCHEME.match(v) and not _NO_HOST.match(v),
    "boolean": lambda v: v.lower() in _BOOLEANS,
    "number": _NUMBER.match,
    "date": _is_date,
}


def _type(sample: list[str]) -> str:
    """The type of four fifths of the values; mixed if they have several."""
    counts = {n: sum(1 for v in sample if of(v)) for n, of in _TYPES.items()}
    for n, count in counts.items():
        if sample and count / len(sample) >= 0.8:
            return n
    return "mixed" if sum(c > 0 for c in counts.values()) > 1 else "string"


def _profile(doc_id: str, content: str) -> Iterator[tuple]:
    lines = [t for t in (line.strip(_BLANK) for line in content.split("\n")) if t]
    if not lines:
        return
    delimiter = _delimiter(lines)
    rows = [_fields(t, delimiter) for t in lines]
    counts = Counter(map(len, rows))
    columns = max(counts, key=counts.__getitem__)  # the first of equals
    names, data = (rows[0], rows[1:]) if _has_header(rows) else ([], rows)
    for i in range(columns):
        values = [r[i] for r in data if i < len(r) and r[i]]
        distinct = dict.fromkeys(values)
        lengths = [len(v) for v in values]
        kind = _type(values[:100])
        low = high = None
        if kind == "number":
            numbers = [float(m[0]) for v in values if (m := _LEADING.match(v))]
            low, high = min(numbers, default=None), max(numbers, default=None)
        mean = sum(lengths) / len(lengths) if lengths else 0.0
        name = (names[i] if i < len(names) else "") or f"Column_{i + 1}"
        yield doc_id, i, name, kind, len(values) < len(data), len(distinct), list(islice(distinct, 5)), min(lengths, default=None), max(lengths, default=None), math.floor(mean * 100 + 0.5) / 100, low, high, columns


def _mapped_profile(batches):
    names = [f.split()[0] for f in _PROFILE.split(", ")]
    for batch in batches:
        rows = [row for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()) if content is not None for row in _profile(doc_id, content)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PROFILE_KINDS)], names)


def csv_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, index, name, type, nullable, unique_values, sample_values, min_length, max_length,
    avg_length, min, max, columns): a row for each column of each document.

    The number of columns is the most frequent row length, the first seen of equals.  Lengths of
    a column without values are null.  A document's cells stay in one Python call and aren't shuffled.
    """
    return docs.select("doc_id", "content").mapInArrow(_mapped_profile, _PROFILE)


def csv(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """A root for the columns and a node with its profile for each of them."""
    profile = csv_profile(docs)
    none = {c: F.lit(None) for c in ("line", "col", "end_line", "end_col", "anchor")}
    plain = lambda c: F.when(F.col(c) == F.floor(c), F.format_string("%.0f", F.col(c))).otherwise(F.col(c).cast("string"))
    head = F.to_json(F.struct("index", F.col("type"), F.col("type").alias("dataType"), "nullable", F.col("unique_values").alias("uniqueValues"), F.col("sample_values").alias("sampleValues"), F.col("min_length").alias("minLength"), F.col("max_length").alias("maxLength")))
    numbers = F.concat(F.lit(',"avgLength":'), plain("avg_length"), *[F.coalesce(F.concat(F.lit(f',"{n}":'), plain(n)), F.lit("")) for n in ("min", "max")])
    columns = profile.select("doc_id", (F.col("index") + 1).alias("node_id"), F.lit(0).alias("parent_id"), F.col("name").alias("title"), F.concat("type", F.lit(" column")).alias("type"), F.lit(2).alias("depth"), F.lit(2).alias("tree_depth"), generate_id(F.col("name"), F.lit("column"), F.col("index")).alias("id"), F.concat(F.regexp_replace(head, r"\}\z", ""), numbers, F.lit("}")).alias("metadata"))
    root = profile.where("index = 0").select("doc_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit("Columns").alias("title"), F.lit("section").alias("type"), F.lit(1).alias("depth"), F.lit(1).alias("tree_depth"), F.lit("csv-columns").alias("id"), F.to_json(F.struct(F.col("columns").alias("count"))).alias("metadata"))
    both = root if max_depth == 1 else root.unionByName(columns)
    return both.withColumns({c: v.cast("string" if c == "anchor" else "int") for c, v in none.items()}).select(*NODE_COLUMNS)
