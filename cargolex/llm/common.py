"""What the operators of this subpackage share: table access, checkpoints and driver-side size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that further columns of the input, whatever their names, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where a local session names none."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cargolex-checkpoint-"))
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table beside the checkpoints and read again; unlike checkpoint() it is compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many ids of 8 bytes are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is among ids (column doc_id)."""
    ids = checkpoint(ids.select("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)
