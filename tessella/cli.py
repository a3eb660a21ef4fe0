"""Command line: outline one file, or list its symbols."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessella import api, sinks
from tessella.errors import OutlineError, UnsupportedExtensionError
from tessella.schema import empty_symbol_table
from tessella.sources.files import read_documents


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("outline")
    one.add_argument("file")
    one.add_argument("-d", "--max-depth", type=int)
    one.add_argument("-f", "--format", default="tree")
    one.add_argument("-o", "--output")
    one.add_argument("-c", "--include-comments", action="store_true")
    one.add_argument("-p", "--include-private", action="store_true")
    one.add_argument("-l", "--line-numbers", action="store_true")
    one.add_argument("--compact", action="store_true")
    table = commands.add_parser("symbols")
    table.add_argument("file")
    table.add_argument("-o", "--output")
    commands.add_parser("list-extensions")
    commands.add_parser("list-formats")
    return parser


def _session() -> SparkSession:
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def _outline(args: argparse.Namespace) -> str:
    docs = _documents(args.file)
    nodes = api.outline(docs, args.max_depth, args.line_numbers, args.include_comments, include_private=args.include_private, only=[Path(args.file).suffix[1:]])
    options = {"compact": args.compact} if args.format.lower() in ("tree", "ascii-tree", "json") else {}
    return sinks.format_outline(nodes, args.format, docs, **options).first()["output"]


def _documents(file: str):
    path = Path(file).resolve()
    if not path.is_file():
        raise OutlineError(f"No such file: {file}")
    if not api.is_supported(path.suffix[1:]):
        raise UnsupportedExtensionError(path.suffix[1:])
    return read_documents(_session(), str(path))


def _symbols(args: argparse.Namespace) -> str:
    docs = _documents(args.file)
    table = empty_symbol_table()
    for s in api.symbols(docs).orderBy("seq").collect():
        entry = {"name": s["name"], "qualifiedName": s["qualified_name"], "kind": s["kind"], "span": {"startLine": s["start_line"], "endLine": s["end_line"]}, "exported": s["exported"]}
        table["symbols"].append(entry | ({"signature": s["signature"]} if s["signature"] else {}))
    table["references"] = [{k: r[k] for k in ("from", "to", "kind", "line")} for r in api.references(docs).orderBy("seq").collect()]
    return json.dumps(table, ensure_ascii=False, indent=2)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "list-extensions":
            text = "\n".join(sorted(api.extensions()))
        elif args.command == "list-formats":
            text = "\n".join(sinks.formats())
        else:
            text = (_outline if args.command == "outline" else _symbols)(args)
    except OutlineError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if getattr(args, "output", None):
        Path(args.output).write_text(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
