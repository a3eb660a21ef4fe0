"""The engine's entry points: outlines, symbols and references of tables of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import UnsupportedExtensionError
from tessella.plans import config, markup, nested
from tessella.plans.code import outline as code
from tessella.schema import NODES, REFERENCES, SYMBOLS

Plan = Callable[..., DataFrame]

_BUILT_IN: tuple[tuple[tuple[str, ...], Plan], ...] = (
    (("md", "markdown"), markup.markdown),
    (("json",), nested.json_outline),
    (("xml",), nested.xml_outline),
    (("html", "htm"), markup.html),
    (("yaml", "yml"), nested.yaml_outline),
    (("csv",), config.csv),
    (code.EXTENSIONS, code.code_outline),
    (("toml",), nested.toml_outline),
    (("rst", "rest"), markup.rst),
    (("adoc", "asciidoc"), markup.asciidoc),
    (("tex", "latex"), markup.latex),
    (("org",), markup.org),
    (("wiki", "mediawiki"), markup.wiki),
    (("ini", "cfg", "conf"), config.ini),
    (("properties", "env"), config.properties),
)
_PARSED = (nested.json_outline, nested.xml_outline, nested.yaml_outline, nested.toml_outline)
_registry: dict[str, Plan] = {ext: plan for extensions, plan in _BUILT_IN for ext in extensions}


def register_extension(ext: str, plan: Plan) -> None:
    """Add or replace the plan of an extension: a function from documents to nodes that takes
    ``max_depth``."""
    _registry[ext.lower()] = plan


def extensions() -> list[str]:
    """All extensions, in the order they were registered."""
    return list(_registry)


def is_supported(ext: str) -> bool:
    return ext.lower() in _registry


def outline(docs: DataFrame, max_depth: int | None = None, include_line_numbers: bool = False, include_comments: bool = False, group_overloads: bool = False, include_private: bool = True, mode: str = "FAILFAST", only: list[str] | None = None) -> DataFrame:
    """Outline nodes of documents (doc_id, ext, content).

    Each format is a plan over the documents of its extensions.  ``only`` names the extensions to
    read: plans of others are left out, and the filter on ``ext`` reaches the scan, so a table
    partitioned by ``ext`` is read once in all.  ``mode`` is FAILFAST, PERMISSIVE or DROPMALFORMED,
    of which the last two skip what can't be parsed; unsupported extensions give no nodes.
    ``include_private`` changes nothing and is taken for completeness.
    """
    wanted = [e.lower() for e in only] if only is not None else extensions()
    for e in wanted:
        if e not in _registry:
            raise UnsupportedExtensionError(e)
    plans: dict[Plan, list[str]] = {}
    for e in wanted:
        plans.setdefault(_registry[e], []).append(e)
    parts = []
    for plan, own in plans.items():
        options: dict = {"max_depth": max_depth}
        if plan is markup.markdown:
            options["include_line_numbers"] = include_line_numbers
        elif plan is code.code_outline:
            options |= {"grouped": group_overloads, "include_comments": include_comments}
        elif plan in _PARSED:
            options["mode"] = "FAILFAST" if mode == "FAILFAST" else "DROPMALFORMED"
        parts.append(plan(docs.where(F.lower("ext").isin(*own)), **options))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], NODES)


def parse_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of the JSON, YAML, XML and TOML documents that can't be parsed."""
    parts = []
    for own, parse in ((("json",), nested.parse_json), (("xml",), nested.parse_xml), (("yaml", "yml"), nested.parse_yaml), (("toml",), nested.parse_toml)):
        parts.append(nested.parsed(docs.where(F.lower("ext").isin(*own)), parse, None, "PERMISSIVE").where("error is not null").select("doc_id", "error"))
    return reduce(DataFrame.unionByName, parts)


def checked(docs: DataFrame) -> DataFrame:
    """``docs``, failing when a row's extension isn't supported."""
    known = F.lower("ext").isin(*extensions())
    return docs.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("No generator found for file extension: "), F.coalesce("ext", F.lit(""))))))


def symbols(docs: DataFrame) -> DataFrame:
    """The symbol table of code documents; other documents have none."""
    return code.symbols(docs) if "ext" in docs.columns else docs.sparkSession.createDataFrame([], SYMBOLS)


def references(docs: DataFrame) -> DataFrame:
    """Call and import edges of code documents; languages without edges have none."""
    return code.references(docs) if "ext" in docs.columns else docs.sparkSession.createDataFrame([], REFERENCES)
