"""Report aggregates over result rows: levels, suspect fields, status of files, totals and the log's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import FIELDS, is_blank
from .rows import ERROR, overall

# Labels of the fields in reports.
LABELS = {"date": "Дата", "number": "№", "shipper": "Грузоотправитель", "consignee": "Грузополучатель", "cargo": "Груз", "volume": "Объём", "driver": "Водитель", "vehicle": "Транспортное средство", "reception": "Приём груза"}
SUSPECT, WARN = 0.5, 0.5


def level(note: Column, total: Column) -> Column:
    own = F.coalesce(note, F.lit(""))
    return F.when(own.startswith(ERROR.strip()), "ERR").when((total < WARN) | own.contains("LOW"), "WARN").otherwise("OK")


def suspect_fields(confidence: Column) -> Column:
    """Labels of the fields that are missing or of a low confidence, in the order of reports."""
    return F.array_compact(F.array(*(F.when((confidence[f] < SUSPECT) | is_blank(F.col(f)), LABELS[f]) for f in FIELDS)))


def percentage(confidence: Column) -> Column:
    return F.bround(overall(confidence) * 100).cast("int")


def confidence_band(pct: Column) -> Column:
    return F.when(pct < 50, "low").when(pct < 70, "mid").otherwise("ok")


def file_status(rows: DataFrame) -> DataFrame:
    """Per file: rows, whether all were read, the mean percentage (half to even) and the status that the command line prints."""
    total = overall(F.col("confidence"))
    own = rows.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.bool_and(~F.coalesce("note", F.lit("")).contains("ERROR")).alias("ok"),
        F.bround(F.avg(total) * 100).cast("int").alias("avg_pct"),
        F.min_by("note", "doc_idx").alias("_first"),
        F.bool_or(total < WARN).alias("_weak"),
    )
    status = F.when(F.coalesce("_first", F.lit("")).startswith(ERROR.strip()), "ERR").when(F.col("_weak"), "WARN").otherwise("OK")
    return own.select("source", "n_rows", "ok", "avg_pct", status.alias("status"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: files, files read, files with errors, rows. Files are summed up first, so no file's rows meet in one task twice."""
    return file_status(rows).agg(F.count("*").alias("files"), F.count_if("ok").alias("ok_files"), F.count_if(~F.col("ok")).alias("err_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def log_lines(rows: DataFrame) -> DataFrame:
    """(source, doc_idx, lines): what the log says of each row."""
    pct = F.lpad(percentage(F.col("confidence")).cast("string"), 3, " ")
    several = F.count("*").over(W.partitionBy("source")) > 1
    name = F.concat(F.col("source"), F.when(several, F.concat(F.lit("#"), (F.col("doc_idx") + 1).cast("string"))).otherwise(""))
    head = F.concat(F.lit("["), level(F.col("note"), overall(F.col("confidence"))), F.lit("] "), pct, F.lit("% | "), name)
    bad = suspect_fields(F.col("confidence"))
    check = F.when(F.size(bad) > 0, F.concat(F.lit("       └─ Проверить: "), F.array_join(bad, ", "))).otherwise("       └─ Все поля распознаны.")
    titled = F.concat(F.lit("       ├─ "), F.col("waybill"), F.lit(" от "), F.coalesce("date", F.lit("отсутствует")))
    failed = F.coalesce("note", F.lit("")).startswith(ERROR.strip())
    return rows.select("source", "doc_idx", F.when(failed, F.array(head, F.concat(F.lit("       └─ "), F.col("note")))).otherwise(F.array(head, titled, check)).alias("lines"))
