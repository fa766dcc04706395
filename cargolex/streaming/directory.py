"""A folder as a stream: every new file is parsed once, and the checkpoint is the memory of what was read.

Parsing keeps no state and shuffles nothing, so its rows go to a file sink as they are: the query is built and analysed once, and the sink's
own log of batches keeps a batch that is tried again from being written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import parse_or_error
from ..sources.files import decoded, normalized


def _name(path: str) -> Column:
    return F.regexp_extract(F.col(path), r"([^/]+)$", 1)


def watch(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(source, text, error) of text files as they come."""
    own = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return own.select(_name("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error"))


def watch_documents(spark: SparkSession, folder: str, decoder: Callable[[bytes], list[dict]], files_a_batch: int = 100) -> DataFrame:
    """(source, text, error) of PDFs as they come; decoder as for sources.files.decoded. A file that cannot be read is a row with its error."""
    own = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    own = own.option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return decoded(own, decoder).withColumn("source", _name("source"))


def parse_to(files: DataFrame, out: str, checkpoint: str, as_of_year: int) -> StreamingQuery:
    """Result rows appended as Parquet, rows of files that could not be read among them, until all files that are there are read."""
    rows = parse_or_error(normalized(files), as_of_year)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
