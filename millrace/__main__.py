"""python -m millrace: list and run queries, learn the variants of a configuration."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import catalog
from .plans import config, corpora
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="the names of the queries")
    run = commands.add_parser("run", help="a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("folder")
    run.add_argument("--out", help="a folder for the result as Parquet; else twenty rows are shown")
    learn = commands.add_parser("train", help="the tokenizers of a configuration")
    for name, text in (("--config", "a family's settings and variants"), ("--train", "text files to learn from"), ("--test", "text files to measure on"), ("--out", "a folder for the results")):
        learn.add_argument(name, required=True, help=text)
    learn.add_argument("--only", help="one variant's name")
    learn.add_argument("--vocab-size", type=int, default=32_000)
    learn.add_argument("--sample", default="", help="a text to encode and decode in the reports")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print(*sorted(catalog.queries()), sep="\n")
        return 0
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    if args.command == "run":
        df = catalog.queries()[args.name](spark, args.folder)
        df.write.parquet(args.out) if args.out else df.show(20, truncate=False)
        return 0
    settings = config.variants(spark.read.text(args.config, wholetext=True).first()[0], args.only)
    for report in corpora.run_variants(readers.text_lines(spark, args.train), readers.text_lines(spark, args.test), settings, args.out, args.vocab_size, args.sample):
        print(json.dumps(report, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
