"""Command line: ``python -m tastegrid.cli NAME --data FOLDER --out FOLDER`` runs a query and writes Parquet."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from tastegrid.functions.runtime import importable_on_workers
from tastegrid.plans import core, reviews
from tastegrid.sources.files import read_records, write_csv


def folder(text: str) -> str:
    """A local folder that is there, or any location with a scheme."""
    if "://" not in text and not Path(text).is_dir():
        raise argparse.ArgumentTypeError(f"no such folder: {text}")
    return text


def positive(text: str) -> int:
    if not text.isdigit() or not int(text):
        raise argparse.ArgumentTypeError(f"not a positive number: {text}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tastegrid", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(core.QUERIES | reviews.QUERIES))
    run.add_argument("--data", type=folder, required=True)
    run.add_argument("--out", required=True)
    convert = commands.add_parser("to-csv", help="records of a JSON or CSV file as CSV")
    convert.add_argument("source")
    convert.add_argument("--out", required=True)
    convert.add_argument("--files", type=positive, default=1, help="number of files written")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    importable_on_workers(spark)
    if asked.command == "run":
        (core.QUERIES | reviews.QUERIES)[asked.name](spark, asked.data).write.mode("overwrite").parquet(asked.out)
    else:
        write_csv(read_records(spark, asked.source).repartition(asked.files), asked.out)


if __name__ == "__main__":
    main()
