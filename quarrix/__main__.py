"""Command line: ``python -m quarrix index|reindex|search|stats|help|version``; exit codes 0, 1 (failed), 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__

COMMANDS = ("index", "reindex", "search", "stats", "help", "version")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrix")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("words", nargs="*")
    parser.add_argument("--root", default=".")
    parser.add_argument("--data-dir", default=None)
    parser.add_argument("--top-k", type=int)
    parser.add_argument("--provider", default="lexical")
    parser.add_argument("--dimension", type=int, default=0)
    parser.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "help":
        parser.print_help()
        return 0
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "search" and not " ".join(args.words).strip():
        print("search needs a query", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .config import DATA_DIR, EngineConfig, ProviderConfig
    from .plans.index import RetrievalIndex
    from .plans.tool import dispatch, render

    try:
        config = EngineConfig(root=args.root, data_dir=args.data_dir or DATA_DIR, provider=ProviderConfig(args.provider, args.dimension)).checked()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quarrix").getOrCreate()
    index = RetrievalIndex(spark, config)
    action = {"index": "reindex"}.get(args.command, args.command)
    if action == "stats":
        index.init()
    query = " ".join(args.words)
    result = dispatch(index, action, query=query, top_k=args.top_k, full=args.command == "index", path=query or None if args.command == "reindex" else None)
    print(json.dumps(result, ensure_ascii=False) if args.json else render(action, result))
    return 0 if result["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
