"""Command line: python -m gaugeworks analyze|export|sync ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import export as exports
from gaugeworks.operators import runs
from gaugeworks.runtime import ship_package
from gaugeworks.sources import logs, report, traces
from gaugeworks.sources.config import TraceConfig
from gaugeworks.taxonomy import EXTRACTION_TASK, SORTER_TASK

METRICS = {"sorter": "subtype_accuracy", "sweep": "subtype_accuracy", "extraction": "overall_extraction"}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gaugeworks")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="report on a table of runs: Parquet, CSV, a workbook or a run log")
    analyze.add_argument("table")
    analyze.add_argument("--kind", choices=["sorter", "extraction", "sweep"], help="default: from the headers")
    analyze.add_argument("--metric", help="default: that of the kind")
    analyze.add_argument("--target", type=float)
    analyze.add_argument("--min-n", type=int, default=0)
    analyze.add_argument("--out")
    export = commands.add_parser("export", help="write the workbook and the code book of a run log")
    export.add_argument("log", help="a run log in lines of JSON, or a table of runs")
    export.add_argument("out", help="the workbook; of a sweep the folder")
    export.add_argument("--kind", choices=["sorter", "extraction", "sweep"], default="sorter")
    export.add_argument("--prompt-version", help="of a sweep; default: the champion's")
    sync = commands.add_parser("sync", help="pull traces and write run records, their workbook and its code book")
    sync.add_argument("url", nargs="?", help="default: from the environment")
    sync.add_argument("out", help="the Parquet table of records; workbook and code book are written beside it")
    sync.add_argument("--session")
    sync.add_argument("--name")
    sync.add_argument("--max-items", type=int)
    sync.add_argument("--public-key")
    sync.add_argument("--secret-key")
    sync.add_argument("--env-file")
    return parser


def _write(frame: DataFrame, out: str) -> str:
    """The workbook with its code book, and the code book as a file beside it."""
    stem = out.removesuffix(".xlsx")
    book = exports.codebook([(c, F.lit(None)) for c in frame.columns], frame)
    logs.write_workbook(f"{stem}.xlsx", frame, "Eval Results", book)
    logs.write_codebook(f"{stem}-codebook.csv", book)
    return f"{stem}.xlsx"


def _export(spark: SparkSession, args: argparse.Namespace) -> str:
    if not args.log.lower().endswith((".jsonl", ".json")):
        return _write(spark.read.parquet(args.log), args.out)
    lines = spark.read.text(args.log).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), "value")
    if args.kind == "sweep":
        os.makedirs(args.out, exist_ok=True)
        return logs.write_sweep(lines, "value", "line", args.out, args.prompt_version)[0]
    extraction = args.kind == "extraction"
    columns = exports.extraction_columns() if extraction else exports.sorter_columns()
    return _write(exports.export_frame(lines, "value", columns, task=EXTRACTION_TASK if extraction else SORTER_TASK), args.out)


def _sync(spark: SparkSession, args: argparse.Namespace) -> str:
    config = TraceConfig.load(args.env_file)
    url = args.url or (config.url if config else None)
    if not url:
        raise SystemExit("no URL: name one or set TRACES_URL, TRACES_PUBLIC_KEY and TRACES_SECRET_KEY")
    keys = {"public_key": args.public_key or (config.public_key if config else ""), "secret_key": args.secret_key or (config.secret_key if config else "")}
    found = traces.list_traces(spark, url, session=args.session, name=args.name, max_items=args.max_items, **keys)
    rows = traces.sorter_rows(found).withColumn("received_at", F.try_to_timestamp("timestamp"))
    records = runs.run_records(rows, model="model", prompt_version="prompt_version")
    records.write.mode("overwrite").parquet(args.out)
    log = runs.as_log_records(spark.read.parquet(args.out), project=url)
    return _write(exports.export_frame(log, "raw", exports.sorter_columns(), task=SORTER_TASK), args.out)


def _analyze(spark: SparkSession, args: argparse.Namespace) -> str:
    frame = logs.read_runs(spark, args.table, args.kind)
    kind = args.kind or logs.workbook_kind(frame.columns, args.table)
    metric = args.metric or METRICS.get(kind) or next(iter(runs.metric_columns(frame)), "subtype_accuracy")
    return report.build_report(frame, metric, target=args.target, min_n=args.min_n)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("gaugeworks").getOrCreate()
    ship_package(spark)
    if args.command != "analyze":
        sys.stdout.write({"export": _export, "sync": _sync}[args.command](spark, args) + "\n")
        return 0
    text = _analyze(spark, args)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
