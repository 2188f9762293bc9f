"""python -m tapeworks: list and run queries, look at data, fill and query the store."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.2"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tapeworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeworks", description=__doc__)
    todo = parser.add_subparsers(dest="command", required=True)
    todo.add_parser("version")
    todo.add_parser("adapters")
    todo.add_parser("queries")
    run = todo.add_parser("run")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("--rows", type=int, default=20)
    look = todo.add_parser("inspect")
    look.add_argument("path")
    look.add_argument("--adapter")
    fill = todo.add_parser("store")
    fill.add_argument("data")
    fill.add_argument("root")
    ask = todo.add_parser("sql")
    ask.add_argument("root")
    ask.add_argument("text")
    ask.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)

    from tapeworks import catalog

    if args.command == "version":
        print(VERSION)
    elif args.command == "adapters":
        from tapeworks.sources import adapters

        for name in adapters.names():
            print(name, adapters.get(name).tier, adapters.get(name).help)
    elif args.command == "queries":
        for name, query in sorted(catalog.queries().items()):
            print(name, (query.__doc__ or "").strip().split("\n")[0])
    elif args.command == "run":
        if args.query not in catalog.queries():
            print(f"no query {args.query!r}", file=sys.stderr)
            return 2
        catalog.queries()[args.query](_session(), args.data).show(args.rows, truncate=False)
    elif args.command == "inspect":
        from tapeworks.sources import adapters

        name = args.adapter or adapters.for_path(args.path).name
        print(json.dumps(adapters.probe(_session(), name, args.path), indent=1, default=str))
    elif args.command == "store":
        from tapeworks.sources import tables

        print(json.dumps(tables.fill_store(_session(), args.data, args.root).status()))
    elif args.command == "sql":
        from tapeworks.sources import tables

        held = tables.store(_session(), args.root)
        if lacking := tables.missing(held, args.text):
            print(f"tables not there yet: {', '.join(lacking)}")
            return 0
        held.views()
        held.spark.sql(args.text).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
