"""Command line: ``python -m siltstone check PROGRAM`` and ``python -m siltstone run PROGRAM``."""

from __future__ import annotations

import argparse
import os
import sys

from .plans import Compiled, compile_program
from .syntax import CompileError, load_program


def _load(args) -> Compiled:
    compiled = compile_program(load_program(args.program, [*args.include_dir, os.getcwd()]))
    print(f"compiled: {args.program}")
    for k, v in compiled.summary().items():
        print(f"{k}: {v}")
    for w in compiled.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return compiled


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    check, run = sub.add_parser("check", help="compile a program"), sub.add_parser("run", help="compile and run a program")
    for p in (check, run):
        p.add_argument("program")
        p.add_argument("-I", "--include-dir", action="append", default=[])
    run.add_argument("--tables", help="folder of Parquet tables of the star schema")
    run.add_argument("--facts", help="folder of Parquet tables of code facts")
    run.add_argument("--relation", action="append", default=[], help="show only this relation; may be repeated")
    run.add_argument("--show-empty", action="store_true")
    run.add_argument("--max-rows", type=int, default=50)
    args = parser.parse_args(argv)
    try:
        compiled = _load(args)
    except CompileError as e:
        print(f"{e.stage} failed:\n{e}", file=sys.stderr)
        return 1
    if args.command == "check":
        return 0

    from pyspark.sql import SparkSession

    from .engine import Engine
    from .render import show
    from .sources.codefacts import CodeFactsHost
    from .sources.hosts import MockHost, ParquetHost

    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        host = ParquetHost(spark, args.tables) if args.tables else CodeFactsHost.from_folder(spark, args.facts) if args.facts else MockHost()
    except Exception as e:
        print(f"the host cannot be opened: {e}", file=sys.stderr)
        return 1
    print(show(Engine(spark, compiled, host).run(), compiled, args.relation, args.show_empty, args.max_rows))
    return 0
