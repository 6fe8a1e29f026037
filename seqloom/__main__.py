"""``python -m seqloom list`` names the queries; ``python -m seqloom run NAME TABLES OUT`` writes one's result as Parquet."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    from seqloom.plans import catalog

    parser = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(catalog.queries()), metavar="NAME")
    run.add_argument("tables")
    run.add_argument("out")
    asked = parser.parse_args(argv)
    if asked.command == "list":
        print("\n".join(f"{k}: {(f.__doc__ or '').splitlines()[0]}" for k, f in sorted(catalog.queries().items())))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    catalog.queries()[asked.name](spark, asked.tables).write.mode("overwrite").parquet(asked.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
