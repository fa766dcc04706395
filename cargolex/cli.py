"""Command line: parse a folder of waybills to a workbook and a log.

Without --decoder the inputs are texts; with it, PDFs whose pages it gives. Rows of files that were read before come from the cache.
Exit codes: 0 all read, 1 no inputs, 2 no such path, 3 some files with errors, 4 the workbook cannot be written.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from datetime import datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.reports import file_status, totals
from .operators.rows import parse_or_error
from .progress import Progress
from .sources import cache as cached_rows
from .sources import sinks
from .sources.files import decoded, file_marks, list_documents, normalized, read_texts


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cargolex", description=__doc__)
    p.add_argument("path", help="a file or a folder of them")
    p.add_argument("-o", "--out", "--output", dest="output", help="workbook; by default extraction.xlsx beside the input")
    p.add_argument("-l", "--log", help="by default beside the workbook")
    p.add_argument("--decoder", metavar="MODULE:FUNCTION", help="reads PDFs: bytes to page dicts, see sources.files.decoded")
    p.add_argument("--cache", help="folder of the rows of files that were read; by default beside the workbook")
    p.add_argument("--no-cache", action="store_true", help="read all files anew")
    p.add_argument("-v", "--verbose", action="store_true", help="tell how many files are done, and a line for each file")
    p.add_argument("--snapshot-json", action="store_true", help="the snapshot as one JSON text, not as a table")
    p.add_argument("--as-of-year", type=int, default=datetime.now().year)
    return p.parse_args(argv)


def decoder_of(named: str) -> Callable[[bytes], list[dict]]:
    module, name = named.split(":")
    return getattr(import_module(module), name)


def _files(spark: SparkSession, path: str, decoder: str | None) -> tuple[DataFrame, DataFrame]:
    """(source, signature, path) of the inputs, and (source, text, error) of them, which reads nothing yet."""
    if decoder:
        marks, read = list_documents(spark, path), decoded(list_documents(spark, path), decoder_of(decoder))
        read = read.withColumn("source", F.regexp_extract("source", r"([^/]+)$", 1))
        marks = marks.select("path", "length", F.col("modificationTime").alias("modified"))
    else:
        names = "*.[tT][xX][tT]" if os.path.isdir(path) else "*"
        read = read_texts(spark, path, names).withColumn("error", F.lit(None).cast("string"))
        marks = file_marks(spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)).select("path", "length", "modified")
    signature = sinks.signature(F.col("path"), F.col("length"), F.col("modified"))
    return marks.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), signature.alias("signature"), "path"), read


def _told(rows: DataFrame) -> None:
    status = file_status(rows).cache()
    n = status.count()
    for i, r in enumerate(status.orderBy("source").toLocalIterator(), 1):
        print(f"  [{r.status:4}] {i}/{n} ({r.avg_pct:>3}%) {r.source}")
    status.unpersist()


def _counted(done: int, total: int) -> None:
    print(f"  {done}/{total} files read")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, progress: Callable[[int, int], None] | None = None) -> int:
    """progress(done, total) is called while files are read; what it raises reaches nobody."""
    args = _arguments(argv)
    if not os.path.exists(args.path):
        print(f"{args.path}: no such path", file=sys.stderr)
        return 2
    suffix = ".pdf" if args.decoder else ".txt"
    single = os.path.isfile(args.path)
    if not ([args.path] if single else [x for x in os.listdir(args.path) if x.lower().endswith(suffix)]):
        print(f"{args.path}: no {suffix} files", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("cargolex").getOrCreate()
    now, began = datetime.now(), time.time()
    output = args.output or os.path.join(os.path.dirname(os.path.abspath(args.path)) if single else args.path, "extraction.xlsx")
    cache = args.cache or os.path.join(os.path.dirname(os.path.abspath(output)), ".cargolex_cache")

    marks, read = _files(spark, args.path, args.decoder)
    known = None if args.no_cache else cached_rows.read(spark, cache)
    told = progress or (_counted if args.verbose else None)
    misses = marks if known is None else sinks.cache_misses(marks, known)
    if known is not None:
        read = read.join(misses, "source", "left_semi")
    watch = Progress(misses.count() if told else 0, told)
    fresh = parse_or_error(normalized(watch.counted(read)), args.as_of_year).cache()
    rows = fresh if known is None else fresh.unionByName(sinks.cache_get(marks, known).select(fresh.columns)).cache()
    try:
        with watch:
            written = sinks.write_workbook_safe(rows, output, now, as_table=not args.snapshot_json)
    except PermissionError as e:
        print(f"{output}: {e}", file=sys.stderr)
        return 4
    if args.verbose:
        _told(rows)
    sinks.write_log_safe(sinks.log_text(rows, args.path, written, time.time() - began, now), args.log or os.path.splitext(written)[0] + ".log", now)
    t = totals(rows).first()
    print(f"{t.files} files, {t.err_files} with errors, {t.n_rows} rows in {time.time() - began:.1f} s: {written}")
    if not args.no_cache:
        # last, as the plans above read the cache
        if cached_rows.put(fresh, marks, cache) % cached_rows.MANY == 0:
            cached_rows.compact(spark, cache)
    return 3 if t.err_files else 0


if __name__ == "__main__":
    sys.exit(main())
