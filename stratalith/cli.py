"""python -m stratalith --format FORMAT [FILE]: runs a script from a file or from standard input.

The whole script is parsed before its first statement runs. Each query's result is printed as it comes, so results before a
statement that fails are out already; statements without a result say nothing. --session takes one statement a line and
prints columns as lists. --tables DIR serves the Parquet files of a folder as tables.
"""

from __future__ import annotations

import argparse
import glob
import os
import sys

from pyspark.sql import SparkSession

from .catalog import entry_of
from .engine import Engine, Result
from .errors import EngineError, SqlError, typed
from .sources import formats
from .sql import parse


def session() -> SparkSession:
    spark = SparkSession.builder.appName("stratalith").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_script(engine: Engine, data: bytes, name: str, out) -> int:
    try:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise SqlError(e.start, "the script is not UTF-8") from None
        shown = False
        for statement in parse(text, engine.sql):
            result = engine.run(statement)
            if isinstance(result, Result):
                if shown and name.lower() == "table":
                    out.write("\n")
                out.write(formats.written(result, name))
                out.flush()
                shown = True
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def run_session(engine: Engine, lines, out) -> int:
    """One statement a line; a query prints its one column, [7, NULL, -2], and an error ends the session."""
    for line in lines:
        if not line.strip():
            continue
        try:
            for result in engine.execute(line):
                if isinstance(result, Result):
                    rows = result.rows()
                    out.write("[" + ", ".join(", ".join(map(formats.display, r)) for r in rows) + "]\n")
        except Exception as e:
            if not isinstance(typed(e), EngineError):
                raise
            print(typed(e), file=sys.stderr)
            return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratalith", description=__doc__.splitlines()[0])
    parser.add_argument("--format", default="table", help="table, csv, tsv, json, JSONEachRow or JSONCompactEachRow")
    parser.add_argument("--session", action="store_true")
    parser.add_argument("--tables", help="a folder of Parquet files")
    parser.add_argument("--serve", type=int, metavar="PORT", help="answer HTTP requests")
    parser.add_argument("file", nargs="?")
    args = parser.parse_args(argv)
    if args.format.lower() not in formats.NAMES:
        parser.error(f"unknown format {args.format}")
    spark = session()
    engine = Engine(spark)
    for path in sorted(glob.glob(f"{args.tables}/*.parquet")) if args.tables else ():
        engine.catalog.add(entry_of(os.path.basename(path).removesuffix(".parquet"), spark.read.parquet(path)))
    if args.serve is not None:
        from .http_server import serve

        serve(engine, args.serve)
        return 0
    stream = open(args.file, "rb") if args.file else sys.stdin.buffer
    with stream:
        if args.session:
            return run_session(engine, (x.decode() for x in stream), sys.stdout)
        return run_script(engine, stream.read(), args.format, sys.stdout)
