"""python -m marginalia [--version | list | run NAME FOLDER]: the registered queries from the command line."""

from __future__ import annotations

import argparse

from marginalia import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marginalia", description="Research retrieval on Spark.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="show the first rows of a query")
    run.add_argument("name")
    run.add_argument("folder", help="folder of the parquet tables")
    asked = parser.parse_args(argv)
    from marginalia.plans import catalogue

    if asked.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if asked.name not in catalogue.QUERIES:
        parser.error(f"no query {asked.name}")
    from marginalia.session import local_session, ship

    spark = local_session()
    ship(spark)
    catalogue.QUERIES[asked.name](spark, asked.folder).show(20)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
