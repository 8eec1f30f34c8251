"""Command line: ingest a catalog, make one up, build a solver database, solve a request."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skyquad.operators import catalog, synthetic
from skyquad.session import Solver
from skyquad.sources import binary, catalog_csv


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="skyquad")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("ingest", help="a CSV catalog to a binary one")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--kind", choices=("hipparcos", "plain"), default="hipparcos")
    c.add_argument("--header", choices=("names", "skip", "none"), default="names")
    c.add_argument("--max-mag", type=float)
    c = commands.add_parser("generate", help="a made-up catalog, as CSV or binary by the target's ending")
    c.add_argument("target")
    c.add_argument("--stars", type=int, default=200)
    c.add_argument("--seed", type=int, default=42)
    c = commands.add_parser("build", help="a solver database of a binary catalog, or of a pattern archive")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--keep-zero-patterns", action="store_true")
    c = commands.add_parser("solve", help="a request's JSON file against a solver database")
    c.add_argument("database")
    c.add_argument("request")
    c.add_argument("--width", type=int, required=True)
    c.add_argument("--height", type=int, required=True)
    args = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "ingest":
        stars = catalog_csv.read_hipparcos(spark, args.source, args.header) if args.kind == "hipparcos" else catalog_csv.read_plain(spark, args.source)
        stars = stars if args.max_mag is None else catalog.brighter_than(stars, args.max_mag)
        binary.write_astr(stars, args.target)
        catalog.stats(stars).show(truncate=False)
    elif args.command == "generate":
        stars = catalog.generated(spark, args.stars, args.seed)
        if args.target.endswith(".csv"):
            catalog_csv.write_plain(stars, args.target)
        else:
            binary.write_astr(stars, args.target)
    elif args.command == "build" and args.source.endswith(".npz"):
        binary.archive_to_adb(spark, args.source, args.target, args.keep_zero_patterns).show()
    elif args.command == "build":
        stars = synthetic.solver_stars(binary.read_astr(spark, args.source))
        binary.write_adb(stars, synthetic.nearest_patterns(stars), args.target)
    else:
        solver = Solver(spark)
        solver.load(args.database)
        with open(args.request, encoding="utf-8") as f:
            print(solver.solve_json(f.read(), args.width, args.height))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
