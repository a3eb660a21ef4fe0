"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "doc_id string, path string, ext string, file_name string, content string"

NODE_COLUMNS = ["doc_id", "node_id", "parent_id", "title", "type", "depth", "tree_depth", "line", "col", "end_line", "end_col", "id", "anchor", "metadata"]
#: One row for each outline node; node_id counts in pre-order from 0, roots have no parent_id.
#: ``depth`` is the declared level, ``tree_depth`` the nesting level; ``metadata`` is JSON.
NODES = "doc_id string, node_id int, parent_id int, title string, type string, depth int, tree_depth int, line int, col int, end_line int, end_col int, id string, anchor string, metadata string"

_PARAMETERS = "array<struct<name:string,type:string,optional:boolean,defaultValue:string>>"
_DOC = "struct<summary:string,params:array<struct<name:string,type:string,description:string>>,returns:struct<type:string,description:string>>"
#: The known metadata keys with their types.
METADATA = (
    "visibility string, isStatic boolean, isAbstract boolean, isVirtual boolean, isAsync boolean, isLocal boolean, "
    f"parameters {_PARAMETERS}, returnType string, typeParameters string, receiver string, dataType string, bases array<string>, "
    f"decorators array<string>, overloads int, docstring string, doc {_DOC}, level int, rawTitle string, argument string, "
    "language string, todo string, priority string, tags array<string>, value string, path string, required boolean, "
    "isArray boolean, hasAttributes boolean, textContent string, count int, index int, type string, nullable boolean, "
    "uniqueValues bigint, sampleValues array<string>, minLength int, maxLength int, avgLength double, min double, max double, "
    "tagName string, id string, className string"
)

SYMBOL_SCHEMA_VERSION = 1
SYMBOL_KINDS = ("class", "interface", "struct", "enum", "enum_member", "trait", "function", "method", "constructor", "property", "field", "constant", "variable", "module", "namespace", "type_alias")
SYMBOLS = "doc_id string, seq int, name string, qualified_name string, kind string, start_line int, end_line int, exported boolean, signature string"
REFERENCES = "doc_id string, seq int, `from` string, `to` string, kind string, line int"


def symbol_table_schema() -> dict:
    """The JSON Schema (draft 07) of a symbol table as the command line prints it."""
    draft = "draft-07"
    text, number = {"type": "string"}, {"type": "integer", "minimum": 1}

    def record(required: dict, optional: dict | None = None) -> dict:
        return {"type": "object", "properties": required | (optional or {}), "required": list(required), "additionalProperties": False}

    symbol = record({"name": text, "qualifiedName": text, "kind": {"enum": sorted(SYMBOL_KINDS)}, "span": record({"startLine": number, "endLine": number}), "exported": {"type": "boolean"}}, {"signature": text})
    reference = record({"from": text, "to": text, "kind": {"enum": ["calls", "imports"]}, "line": number})
    table = record({"schemaVersion": {"const": SYMBOL_SCHEMA_VERSION}, "symbols": {"type": "array", "items": symbol}, "references": {"type": "array", "items": reference}})
    return {"$schema": f"http://json-schema.org/{draft}/schema#", "title": "SymbolTable"} | table


def empty_symbol_table() -> dict:
    return {"schemaVersion": SYMBOL_SCHEMA_VERSION, "symbols": [], "references": []}


def with_typed_metadata(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``metadata`` as a struct of the known keys, for typed queries."""
    return nodes.withColumn("metadata", F.from_json("metadata", METADATA))
