"""Folders of versions: each is written once, and readers see those alone that were written whole."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str, key: str = "version") -> list[int]:
    """Numbers of the folders <key>=<number> that were written whole; the marker of success is the last file of each."""
    glob, fs = _hadoop(spark, f"{path}/{key}=*/_SUCCESS")
    found = fs.globStatus(glob) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def remove(spark: SparkSession, path: str) -> None:
    own, fs = _hadoop(spark, path)
    fs.delete(own, True)
