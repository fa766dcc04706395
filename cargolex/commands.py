"""Commands beside parsing: what operators corrected, statistics of it, accuracy over a folder, and golden cases.

    python -m cargolex.commands collect edited.xlsx      differences from the snapshot beside it, added to the log of corrections
    python -m cargolex.commands stats                    corrections by field, the most frequent ones, and those of confident values
    python -m cargolex.commands accuracy in/ expected/   verdicts by field against expert files
    python -m cargolex.commands golden case.txt --merge  the expectations of a golden case from what is parsed now

Exit codes: 0 done, 1 nothing to read, 2 no such case.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import decoder_of
from .operators import feedback, scoring
from .operators.rows import parse
from .schema import CORRECTION
from .sources import files, sinks, snapshots

#: Changes that a dry run shows.
SHOWN = 10


def _error(text: str, code: int) -> int:
    print(text, file=sys.stderr)
    return code


def _snapshot_of(workbook: str, named: str | None) -> str | None:
    """The snapshot that was named, else the table or the JSON text beside a workbook."""
    return next((x for x in ([named] if named else [snapshots.beside(workbook), f"{workbook}.snapshot.json"]) if os.path.exists(x)), None)


def collect(spark: SparkSession, args: argparse.Namespace, now: datetime) -> int:
    place = _snapshot_of(args.workbook, args.snapshot)
    if not os.path.exists(args.workbook) or place is None:
        return _error(f"{args.workbook if place else args.snapshot or snapshots.beside(args.workbook)}: no such file", 1)
    edited = files.read_workbooks(spark, args.workbook)
    found = feedback.differences(files.read_snapshot(spark, place), edited).cache()
    counts = feedback.counts_by_field(found).collect()  # one row a field
    print(f"{sum(r.n for r in counts)} corrections")
    for r in counts:
        print(f"  {r.field:10} {r.n}")
    if args.dry_run:
        for r in found.orderBy("excel_row", "field_no").limit(SHOWN).collect():
            print(f"  [{r.kind}] {r.source} / {r.field}: {r.original!r} -> {r.corrected!r} ({r.original_confidence:.2f})")
    elif counts:
        own = found.withColumns({"timestamp": F.lit(f"{now:%Y-%m-%dT%H:%M:%S}"), "context": F.lit(None).cast("string")})
        sinks.append_corrections(own.select(*(x.split()[0] for x in CORRECTION.split(", "))), args.log)
    found.unpersist()
    return 0


def stats(spark: SparkSession, args: argparse.Namespace, now: datetime) -> int:
    if not os.path.exists(args.log):
        print(f"{args.log}: no corrections")
        return 0
    own = files.read_corrections(spark, args.log).withColumn("seq", F.monotonically_increasing_id()).cache()
    print(f"{own.count()} corrections")
    for r in feedback.statistics(own).collect():
        print(f"  {r.field:10} {r.total:6} fix {r.fix} fill {r.fill} clear {r.clear} confidence {r.avg_conf:.2f}")
    for r in feedback.top_patterns(own, args.top).collect():
        print(f"  [{r.n:3}] {r.field}: {r.original!r} -> {r.corrected!r}")
    for r in feedback.confident_mistakes(own, args.top).collect():
        print(f"  [{r.original_confidence:.2f}] {r.field}: {r.original!r} -> {r.corrected!r}")
    own.unpersist()
    return 0


def _inputs(spark: SparkSession, folder: str, decoder: str | None) -> DataFrame:
    """(path, source, text) of a folder: texts, or with a decoder documents with the texts beside them."""
    if not decoder:
        own = files.read_texts(spark, folder, "*.[tT][xX][tT]")
    else:
        named = files.decoded(files.list_documents(spark, folder), decoder_of(decoder)).withColumn("source", F.regexp_extract("source", r"([^/]+)$", 1))
        own = files.with_sidecars(named, files.read_texts(spark, folder, "*.[tT][xX][tT]"))
    return files.normalized(own.select(F.col("source").alias("path"), "source", "text"))


def accuracy(spark: SparkSession, args: argparse.Namespace, now: datetime) -> int:
    for folder in (args.inputs, args.expected):
        if not os.path.isdir(folder):
            return _error(f"{folder}: no such folder", 1)
    judged = scoring.folder_verdicts(_inputs(spark, args.inputs, args.decoder), files.read_expected(spark, args.expected), args.as_of_year).cache()
    if args.verbose:
        for r in judged.orderBy("path", "field").toLocalIterator():
            print(f"  {r.verdict:4} {r.path} / {r.field}")
    for r in scoring.accuracy(judged).orderBy(F.col("field").asc_nulls_last()).collect():
        print(f"  {r.field or 'TOTAL':10} ok={r.ok} fail={r.fail} skip={r.skip} acc={'-' if r.pct is None else f'{r.pct}%'}")
    judged.unpersist()
    return 0


def golden(spark: SparkSession, args: argparse.Namespace, now: datetime) -> int:
    if not os.path.isfile(args.case) or not args.case.endswith(".txt"):
        return _error(f"{args.case}: no such case", 2)
    place = f"{args.case.removesuffix('.txt')}.expected.json"
    fresh = scoring.fresh_rules(parse(files.normalized(files.read_texts(spark, args.case)), args.as_of_year))
    previous = None
    if args.merge and os.path.exists(place):
        case = F.lit(os.path.basename(args.case).removesuffix(".txt")).alias("case")
        previous = scoring.golden_rules(spark.read.text(place, wholetext=True).select(case, F.col("value").alias("text")))
    # one text, that of the case
    for r in scoring.golden_json(scoring.frozen(fresh, previous)).collect():
        with open(f"{place}.part", "w", encoding="utf-8") as f:
            f.write(r.text + "\n")
        os.replace(f"{place}.part", place)
        print(place)
    return 0


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cargolex.commands", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    own = p.add_subparsers(dest="command", required=True)
    log, year = {"default": "feedback/corrections", "help": "folder of the log of corrections"}, {"type": int, "default": datetime.now().year}
    one = own.add_parser("collect")
    one.add_argument("workbook")
    one.add_argument("--snapshot", help="by default the one beside the workbook")
    one.add_argument("--log", **log)
    one.add_argument("--dry-run", action="store_true", help="show corrections and write nothing")
    one = own.add_parser("stats")
    one.add_argument("--log", **log)
    one.add_argument("--top", type=int, default=10)
    one = own.add_parser("accuracy")
    one.add_argument("inputs")
    one.add_argument("expected")
    one.add_argument("--decoder", metavar="MODULE:FUNCTION")
    one.add_argument("-v", "--verbose", action="store_true")
    one.add_argument("--as-of-year", **year)
    one = own.add_parser("golden")
    one.add_argument("case", help="<case>.txt; its rules stand beside it")
    one.add_argument("--merge", action="store_true", help="rules that are there stay as they are")
    one.add_argument("--as-of-year", **year)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    run = {"collect": collect, "stats": stats, "accuracy": accuracy, "golden": golden}[args.command]
    return run(spark or SparkSession.builder.appName("cargolex").getOrCreate(), args, datetime.now())


if __name__ == "__main__":
    sys.exit(main())
