"""A snapshot as a table: its rows as JSON lines in partitions, and a small head that makes them a snapshot, written last.

Rows are numbered in the order of files without passing one task: a row knows its partition and its place in it, and the head holds the first
number of each partition.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.feedback import snapshot
from ..schema import SNAPSHOT_ROW
from . import versions

SCHEMA_VERSION = 1
#: Bits of a row's number within its partition.
_BITS = 33
_HEAD = "schema_version int, generated_at string, part long, first long, n_rows long"


def beside(workbook: str) -> str:
    """Where a workbook's snapshot stands: in a hidden folder, which readers of the folder of inputs pass over."""
    folder, name = os.path.split(workbook)
    return os.path.join(folder, f".{name}.snapshot")


def write(rows: DataFrame, path: str, now: datetime) -> int:
    """Result rows as the next version of the snapshot at path; its number. Readers see it once its head is whole."""
    spark = rows.sparkSession
    number = max(versions.numbers(spark, f"{path}/head"), default=0) + 1
    # the identifier counts on within a partition of the sorted rows
    placed = snapshot(rows.orderBy("source", "doc_idx")).withColumn("_id", F.monotonically_increasing_id())
    place = f"{path}/rows/version={number}"
    placed.write.mode("overwrite").json(place)
    parts = spark.read.schema("_id long").json(place).groupBy(F.shiftright("_id", _BITS).alias("part")).agg(F.count("*").alias("n_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    head = parts.select("part", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"), "n_rows")
    stamped = head.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(f"{now:%Y-%m-%dT%H:%M:%S}").alias("generated_at"), "part", "first", "n_rows")
    stamped.coalesce(1).write.mode("overwrite").json(f"{path}/head/version={number}")
    return number


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(versions.numbers(spark, f"{path}/head"))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default, with row_no."""
    number = number or versions.numbers(spark, f"{path}/head")[-1]
    schema = T.StructType([*SNAPSHOT_ROW, T.StructField("_id", T.LongType())])
    head = spark.read.schema(_HEAD).json(f"{path}/head/version={number}").select("part", "first")
    own = spark.read.schema(schema).json(f"{path}/rows/version={number}").withColumn("part", F.shiftright("_id", _BITS))
    at = F.col("first") + F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))
    return own.join(head, "part").select(at.cast("int").alias("row_no"), *SNAPSHOT_ROW.fieldNames())
