"""Command line: index, find, show, members, stats and clean; an unknown command is a search."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.format import line
from .plans.catalog import Catalog
from .sources import discover

COMMANDS = ("index", "find", "show", "members", "stats", "clean")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "find")
    parser = argparse.ArgumentParser(prog="tomeline", description=__doc__)
    parser.add_argument("--catalog", default=str(Path.home() / ".local/state/tomeline"))
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("--catalog", default=argparse.SUPPRESS)
        if name == "index":
            p.add_argument("-f", "--force", action="store_true")
            p.add_argument("-p", "--project", action="append", type=Path, default=[])
        if name in ("find", "show", "members"):
            p.add_argument("query")
        if name == "find":
            p.add_argument("-n", "--limit", type=int, default=20)
            p.add_argument("-t", "--type")
            p.add_argument("--color", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tomeline").getOrCreate()
    catalog = Catalog(spark, args.catalog)
    try:
        return _run(args, catalog)
    except RuntimeError as error:
        print(error, file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, catalog: Catalog) -> int:
    if args.command == "index":
        n = catalog.build(projects=args.project, force=args.force)
        print("Index is up to date" if n < 0 else f"Indexed {n} symbols")
    elif args.command == "stats":
        found = catalog.stats()
        print("\n".join(f"{k}: {v}" for k, v in found.items()))
        return int("error" in found)
    elif args.command == "clean":
        print("\n".join(catalog.clean()) or "Nothing to remove")
    elif args.command == "find":
        rows = catalog.ensure().find(args.query, args.limit, args.type)
        for r in rows.orderBy("rank").select(line(args.color).alias("line")).collect():
            print(r.line)
        if text := catalog.find_hint(rows, discover.find_venv_cached() is not None):
            print(text)
        if (name := catalog.single(rows)) is not None:
            print(catalog.show(name))
    elif args.command == "show":
        found = catalog.ensure().show(args.query)
        print(found if isinstance(found, str) else "Not found. Did you mean:\n" + "\n".join(found) if found else "Not found")
        return int(not isinstance(found, str))
    else:
        lines = [r.line for r in catalog.ensure().members(args.query).select(line().alias("line")).collect()]
        print("\n".join(lines) or "No members")
        return int(not lines)
    return 0


if __name__ == "__main__":
    sys.exit(main())
