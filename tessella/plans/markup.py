"""Outlines of line-oriented markup, as plans over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import DOT, NS, SPACE, WS, trim
from tessella.operators.lines import explode_lines, split_lines
from tessella.operators.tree import ITEM_COLUMNS, assemble, assemble_unbounded, filter_depth

LATEX_RANKS = ["part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph"]
LATEX_ENVIRONMENTS = "algorithm align corollary definition equation figure lemma listing lstlisting minted proof proposition table tabular theorem verbatim".split()
_HASHES = rf"^(#{{1,6}}){WS}+({DOT}+)\z"
_EQUALS = rf"^(={{1,6}}){WS}+({DOT}+)\z"
_ADOC_BLOCK = rf"^\[([^\]]+)\]{WS}*\z"
_WIKI = rf"^(={{1,6}}){WS}*({DOT}+?){WS}*\1{WS}*\z"
_WIKI_CODE = rf"(?i)<(?:source|syntaxhighlight)\b[^>]*?\blang=[\"']?([A-Za-z0-9_+-]+)"
_STARS = rf"^(\*+){WS}+({DOT}+)\z"
_ORG_BLOCK = rf"(?i)^{WS}*#\+begin_([A-Za-z0-9_]+)({DOT}*)\z"
_LATEX = rf"^{WS}*\\({'|'.join(LATEX_RANKS)})\*?{WS}*\{{({DOT}+?)\}}"
_ENVIRONMENT = r"\\begin\{([A-Za-z0-9_]+)\*?\}"


def _meta(*fields: Column) -> Column:
    """JSON of the fields that are there; null if none is."""
    text = F.to_json(F.struct(*fields))
    return F.when(text != "{}", text)


def _items(rows: DataFrame, **columns: Column) -> DataFrame:
    have = {"seq": F.col("line"), "metadata": F.lit(None).cast("string"), "is_section": F.lit(True)} | columns
    for c in ("depth",):
        have[c] = have[c].cast("int")
    return rows.select("doc_id", *[have.get(c, F.col(c)).alias(c) if c in have else F.col(c) for c in ITEM_COLUMNS[1:]])


def markdown(docs: DataFrame, max_depth: int | None = None, include_line_numbers: bool = False, strict: bool = False) -> DataFrame:
    """ATX headings.  Front matter is cut off first and lines count from the body's start; they
    are shown only with ``include_line_numbers``, but ids always have them.  Lines end at \\n only.
    ``strict`` leaves out headings in fenced code, which otherwise count."""
    front = r"(?s)\A---(?!-)[^\n]*\n(.*?)(?:\n---|\z)"
    whole = F.regexp_extract("content", front, 0)
    body = F.when(whole != "", F.regexp_replace(F.substring(F.col("content"), F.length(whole) + 1, F.length("content")), r"\A\r?\n", "")).otherwise(F.col("content"))
    matter = F.when(whole != "", F.regexp_extract("content", front, 1))
    cut = docs.select("doc_id", body.alias("content"), matter.alias("matter"))
    if strict:
        cut = cut.withColumn("content", F.regexp_replace("content", r"(?m)^(```|~~~)[^\n]*\n(?s:.*?)(?:^\1[^\n]*$|\z)", ""))
    rows = explode_lines(cut, keep=_HASHES, normalize=False, beside=("matter",))
    level = F.length(F.regexp_extract("text", _HASHES, 1))
    raw = F.regexp_extract("text", _HASHES, 2)
    meta = _meta(level.alias("level"), raw.alias("rawTitle"), F.when(F.col("line") == 1, F.col("matter")).alias("frontmatter"))
    nodes = assemble(filter_depth(_items(rows, title=trim(raw), type=F.lit("heading"), depth=level, metadata=meta), max_depth), levels=6)
    return nodes if include_line_numbers else nodes.withColumns({"line": F.lit(None).cast("int"), "col": F.lit(None).cast("int")})


def asciidoc(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``=`` headings, and ``[...]`` lines as blocks with the language of source blocks."""
    rows = explode_lines(docs, keep=f"{_EQUALS}|{_ADOC_BLOCK}")
    heading = F.col("text").rlike(_EQUALS)
    parts = F.transform(F.split(F.regexp_extract("text", _ADOC_BLOCK, 1), ","), trim)
    language = F.when((F.lower(parts[0]) == "source") & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))
    return assemble(_items(rows, title=F.when(heading, trim(F.regexp_extract("text", _EQUALS, 2))).otherwise(parts[0]), type=F.when(heading, "heading").otherwise("block"), is_section=heading, depth=F.length(F.regexp_extract("text", _EQUALS, 1)), metadata=F.when(~heading, _meta(language.alias("language")))), max_depth, 6)


def latex(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sectioning commands, their depth from the shallowest one of the document, and selected
    environments; comments are cut off and a line with a section has no environments."""
    lines = explode_lines(docs, keep=rf"\\(?:begin|{'|'.join(LATEX_RANKS)})").withColumn("text", F.regexp_replace("text", r"(?s)(?<!\\)%.*\z", ""))
    name = F.regexp_extract("text", _LATEX, 1)
    rank = F.when(name != "", F.array_position(F.array(*map(F.lit, LATEX_RANKS)), name) - 1)
    least = F.min("rank").over(Window.partitionBy("doc_id"))
    found = F.filter(F.regexp_extract_all("text", F.lit(_ENVIRONMENT), 1), lambda e: e.isin(LATEX_ENVIRONMENTS))
    titles = F.when(F.col("rank").isNotNull(), F.array(trim(F.regexp_extract("text", _LATEX, 2)))).otherwise(found)
    rows = lines.withColumn("rank", rank).withColumn("depth", F.col("rank") - least + 1).select("doc_id", "line", "rank", "depth", F.posexplode(titles).alias("k", "title"))
    return assemble(_items(rows, seq=F.col("line") * 100_000 + F.col("k"), type=F.when(F.col("rank").isNotNull(), "section").otherwise("environment"), is_section=F.col("rank").isNotNull(), depth=F.col("depth")), max_depth, 7)


def org(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Star headings of any depth, with state, priority and tags taken from the title, and
    ``#+BEGIN_`` blocks."""
    rows = explode_lines(docs, keep=rf"{_STARS}|{_ORG_BLOCK}")
    heading = F.col("text").rlike(_STARS)
    todo, priority, tags = rf"^(CANCELLED|DONE|NEXT|TODO|WAITING)\b{WS}*", rf"^\[#([A-Z])\]{WS}*", rf"{WS}+(:[A-Za-z0-9_@%#:]+:){WS}*\z"
    rows = rows.withColumn("t0", trim(F.regexp_extract("text", _STARS, 2))).withColumn("t1", F.regexp_replace("t0", todo, "")).withColumn("t2", F.regexp_replace("t1", priority, "")).withColumn("t3", trim(F.regexp_replace("t2", tags, "")))
    some = lambda c: F.when(c != "", c)
    tag_list = F.filter(F.split(F.regexp_extract("t2", tags, 1), ":"), lambda t: t != "")
    meta = _meta(some(F.regexp_extract("t0", todo, 1)).alias("todo"), some(F.regexp_extract("t1", priority, 1)).alias("priority"), F.when(F.col("t2").rlike(tags), tag_list).alias("tags"))
    block = F.upper(F.regexp_extract("text", _ORG_BLOCK, 1))
    language = F.when(block == "SRC", some(F.regexp_extract(F.regexp_extract("text", _ORG_BLOCK, 2), f"{NS}+", 0)))
    return assemble_unbounded(_items(rows, title=F.when(heading, F.col("t3")).otherwise(block), type=F.when(heading, "heading").otherwise("block"), is_section=heading, depth=F.length(F.regexp_extract("text", _STARS, 1)), metadata=F.when(heading, meta).otherwise(_meta(language.alias("language")))), max_depth)


def wiki(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``=`` headings on both sides, their depth from the shallowest one, and highlighted code."""
    rows = explode_lines(docs, keep=rf"{_WIKI}|{_WIKI_CODE}")
    heading = F.col("text").rlike(_WIKI)
    level = F.when(heading, F.length(F.regexp_extract("text", _WIKI, 1)))
    rows = rows.withColumn("level", level).withColumn("least", F.min("level").over(Window.partitionBy("doc_id")))
    language = F.regexp_extract("text", _WIKI_CODE, 1)
    return assemble(_items(rows, title=F.when(heading, trim(F.regexp_extract("text", _WIKI, 2))).otherwise("syntaxhighlight"), type=F.when(heading, "heading").otherwise("block"), is_section=heading, depth=F.col("level") - F.col("least") + 1, metadata=F.when(~heading, _meta(language.alias("language")))), max_depth, 6)


_ADORNMENT = rf"^([^A-Za-z0-9_{SPACE}])\1+\z"
_DIRECTIVE = rf"^\.\.{WS}+([A-Za-z0-9_-]+)::{WS}*({DOT}*)\z"


def rst(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Titles with adornments, whose styles get their depths in order of appearance, and
    directives.  A title uses up its adornments, so lines are taken one after another: a fold over
    each document's lines, without a shuffle; only then do windows rank the styles."""
    item = "struct<line:int,title:string,style:string,argument:string>"

    def step(acc, x):
        i, line, one, two = x["i"], x["t"], x["n1"], x["n2"]
        mark = line.rlike(_ADORNMENT)
        first = F.substring(line, 1, 1)
        over = mark & two.isNotNull() & (one != "") & ~one.rlike(_ADORNMENT) & two.rlike(_ADORNMENT) & (F.substring(two, 1, 1) == first) & (F.length(line) >= F.length(one)) & (F.length(two) >= F.length(one))
        under = ~mark & (line != "") & one.rlike(_ADORNMENT) & (F.length(one) >= F.length(line)) & ~line.rlike(_DIRECTIVE)
        free = i >= acc["next"]
        none = F.lit(None).cast("string")
        argument = trim(F.regexp_extract(line, _DIRECTIVE, 2))
        found = (
            F.when(free & over, F.struct((i + 2).alias("line"), one.alias("title"), F.concat(F.lit("over:"), first).alias("style"), none.alias("argument")))
            .when(free & under, F.struct((i + 1).alias("line"), line.alias("title"), F.concat(F.lit("under:"), F.substring(one, 1, 1)).alias("style"), none.alias("argument")))
            .when(free & line.rlike(_DIRECTIVE), F.struct((i + 1).alias("line"), F.regexp_extract(line, _DIRECTIVE, 1).alias("title"), none.alias("style"), F.when(argument != "", argument).alias("argument")))
        )
        after = F.when(free & over, i + 3).when(free & under, i + 2).otherwise(acc["next"])
        return F.struct(after.cast("int").alias("next"), F.when(found.isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).cast(f"array<{item}>").alias("out"))

    trimmed = docs.select("doc_id", F.transform(split_lines(F.col("content")), trim).alias("t"))
    numbered = F.transform("t", lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.get(F.col("t"), i + 1).alias("n1"), F.get(F.col("t"), i + 2).alias("n2")))
    start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{item}>").alias("out"))
    folded = F.aggregate(F.filter(numbered, lambda x: x["t"].rlike(rf"{_ADORNMENT}|{_DIRECTIVE}") | x["n1"].rlike(_ADORNMENT)), start, step, lambda a: a["out"])
    rows = trimmed.select("doc_id", F.explode(folded).alias("x")).select("doc_id", "x.*")
    appears = F.min("line").over(Window.partitionBy("doc_id", "style"))
    rows = rows.repartition("doc_id").withColumn("since", F.when(F.col("style").isNotNull(), appears)).withColumn("depth", F.size(F.collect_set("since").over(Window.partitionBy("doc_id").orderBy("since").rangeBetween(Window.unboundedPreceding, 0))))
    section = F.col("style").isNotNull()
    return assemble_unbounded(_items(rows, type=F.when(section, "heading").otherwise("directive"), is_section=section, depth=F.col("depth"), metadata=F.when(~section, _meta(F.col("argument")))), max_depth)


_HEADING = r"(?is)<h([1-6])\b([^>]*)>(.*?)</h\1\s*>"
_SEMANTIC = r"(?is)<(article|section|nav|aside|main|header|footer)\b([^>]*)>"


def _attribute(name: str, text: Column) -> Column:
    pattern = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(text, pattern, g) for g in (1, 2, 3)])
    return F.when(value != "", value)


def html(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Headings h1 to h6, then the semantic elements, which are sections of depth 1 named by id,
    class or tag.  Comments, scripts and styles are cut out first; everything is JVM-side regular
    expressions, and an element without its end tag is skipped if it is a heading."""
    clean = F.regexp_replace("content", r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    texts = docs.select("doc_id", clean.alias("c"))
    headings = texts.select("doc_id", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("c", F.lit(_HEADING), g).alias(n) for g, n in ((1, "level"), (2, "attrs"), (3, "inner"))])).alias("k", "h"))
    plain = F.regexp_replace("h.inner", r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    level = F.col("h.level").cast("int")
    head_id = _attribute("id", F.col("h.attrs"))
    heads = headings.select("doc_id", F.col("k").alias("seq"), trim(plain).alias("title"), F.lit("heading").alias("type"), level.alias("depth"), head_id.alias("own_id"), _meta(F.concat(F.lit("h"), level.cast("string")).alias("tagName"), head_id.alias("id"), level.alias("level")).alias("metadata")).where("title <> ''")
    parts = texts.select("doc_id", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("c", F.lit(_SEMANTIC), g).alias(n) for g, n in ((1, "tag"), (2, "attrs"))])).alias("k", "h"))
    part_id, part_class, tag = _attribute("id", F.col("h.attrs")), _attribute("class", F.col("h.attrs")), F.lower("h.tag")
    sections = parts.select("doc_id", (F.col("k") + 1_000_000).alias("seq"), F.coalesce(part_id, part_class, tag).alias("title"), F.lit("section").alias("type"), F.lit(1).alias("depth"), part_id.alias("own_id"), _meta(tag.alias("tagName"), part_id.alias("id"), part_class.alias("className")).alias("metadata"))
    rows = heads.unionByName(sections).withColumn("line", F.lit(None).cast("int")).withColumn("is_section", F.lit(True))
    nodes = assemble(filter_depth(rows, max_depth).withColumn("metadata", F.to_json(F.struct(F.col("own_id").alias("i"), F.col("metadata").alias("m")))), levels=6)
    own = F.get_json_object("metadata", "$.i")
    return nodes.withColumn("anchor", F.when(F.col("type") == "heading", F.coalesce(own, F.col("anchor"))).otherwise(own)).withColumn("id", F.when(F.col("type") == "heading", F.coalesce(own, F.col("id"))).otherwise(F.col("id"))).withColumn("metadata", F.get_json_object("metadata", "$.m"))
