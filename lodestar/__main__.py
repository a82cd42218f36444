"""python -m lodestar [script.sql] [-c SQL] [--import t=f] [--attach t=f] | bench [--rows N]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Session
from .shell import Shell


def lines():
    while True:
        try:
            yield input("lodestar> ")
        except EOFError:
            return


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = argparse.ArgumentParser(prog="lodestar", description="A strictly typed SQL engine on Spark.")
    parser.add_argument("script", nargs="?", help="a file of statements, or `bench`")
    parser.add_argument("-c", metavar="SQL", help="run this and leave")
    parser.add_argument("--import", dest="imports", action="append", default=[], metavar="t=file.csv")
    parser.add_argument("--attach", action="append", default=[], metavar="t=path")
    parser.add_argument("--rows", type=int, default=500_000, help="rows of the benchmark's table")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.script == "bench":
        from .benchmark import report

        sys.stdout.write(report(spark, args.rows))
        return 0
    shell = Shell(Session(spark))
    say = sys.stdout.write
    try:
        for pairs, load in ((args.imports, shell.session.import_csv), (args.attach, shell.session.attach)):
            for pair in pairs:
                name, found, path = pair.partition("=")
                if not found:
                    parser.error(f"expected table=path, found {pair}")
                load(name, path)
        if args.c is not None:
            return 0 if shell.script([args.c], say) else 1
    except EngineError as e:
        say(f"{e}\n")
        return 1
    if args.script:
        with open(args.script, encoding="utf-8") as text:
            return 0 if shell.script(text, say) else 1
    shell.prompt(lines(), say)
    return 0


if __name__ == "__main__":
    sys.exit(main())
