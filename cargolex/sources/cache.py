"""The cache of parsed files: batches of rows, and bases that take the place of the batches before them.

Each run adds a batch, a folder of its own, so that what a run that died has left is never read. Compaction writes a new base that holds one
version of each file, the one that was put last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .sinks import cacheable

#: Batches that readers put up with before a run compacts them.
MANY = 16


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The newest base, if there is one, and the batches that it does not hold."""
    base = versions.numbers(spark, path, "base")[-1:]
    return [("base", n) for n in base] + [("batch", n) for n in versions.numbers(spark, path, "batch") if n > max(base, default=0)]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All cached rows, with the signature and path of their file and the number of their batch (put); None if there are none."""
    parts = [spark.read.parquet(f"{path}/{key}={n}") for key, n in _parts(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def put(rows: DataFrame, files: DataFrame, path: str) -> int:
    """Adds the rows of files(source, signature, path) as a batch, which readers see once it is whole; its number. Rows of files that could not be
    read stay out."""
    spark = rows.sparkSession
    number = max((n for key in ("base", "batch") for n in versions.numbers(spark, path, key)), default=0) + 1
    own = files.select("source", "signature", F.col("path").alias("cached_path"))
    cacheable(rows).join(own, "source").withColumn("put", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return number


def current(cached: DataFrame) -> DataFrame:
    """The rows of each path's version that was put last; what several runs have put of it counts once. Partial sums, no window."""
    last = cached.groupBy("cached_path").agg(F.max(F.struct("put", "signature")).alias("_last"))
    last = last.select("cached_path", "_last.*")
    return cached.join(last, ["cached_path", "put", "signature"], "left_semi").select(cached.columns)


def compact(spark: SparkSession, path: str, there: DataFrame | None = None) -> int | None:
    """Writes the current rows as the next base, near signatures near each other, and removes what it holds; its number, None if there is nothing
    to do. With there(path), rows of files that are no more are left out. No other run may read the cache meanwhile."""
    parts = _parts(spark, path)
    if not any(key == "batch" for key, _ in parts):
        return None
    rows = current(read(spark, path))
    if there is not None:
        rows = rows.join(there.select(F.col("path").alias("cached_path")).distinct(), "cached_path", "left_semi")
    number = max(n for _, n in parts)
    rows.repartitionByRange("signature").sortWithinPartitions("signature").write.mode("overwrite").parquet(f"{path}/base={number}")
    for key, n in parts:
        if (key, n) != ("base", number):
            versions.remove(spark, f"{path}/{key}={n}")
    return number
