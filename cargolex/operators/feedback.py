"""Operator corrections: snapshots, their difference from edited rows, and statistics of the corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import strip
from ..schema import FIELDS, is_blank, shown
from .rows import overall

CONFIDENT = 0.8


def snapshot(rows: DataFrame) -> DataFrame:
    """Result rows to the wide snapshot: a value and a confidence for each field."""
    pairs = [c for f in FIELDS for c in (shown(F.col(f)).alias(f), F.col("confidence")[f].alias(f"{f}_conf"))]
    return rows.select(F.col("row_source").alias("source"), *pairs, overall(F.col("confidence")).alias("overall_confidence"), "waybill", F.coalesce("note", F.lit("")).alias("note"))


def kind(original: Column, corrected: Column) -> Column:
    """fill for a blank that was filled, clear for a value that was blanked, else fix."""
    return F.when(is_blank(original) & ~is_blank(corrected), "fill").when(~is_blank(original) & is_blank(corrected), "clear").otherwise("fix")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", F.coalesce(F.nullif(F.col("source").cast("string"), F.lit("")), F.concat(F.lit("__row_"), F.col("row_no").cast("string"))))


#: Rows of one key that one task joins, about.
SPLIT = 100_000


def _join_frequent(rows: DataFrame, one_each: DataFrame) -> DataFrame:
    """rows joined with one_each (a row for each _key). Keys of more than SPLIT rows, of which there are at most one in SPLIT rows, are
    salted on both sides."""
    hot = rows.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select("_key", F.ceil(F.col("n") / SPLIT).cast("int").alias("_parts"))
    parts = lambda df: df.join(F.broadcast(hot), "_key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    salted = parts(rows).withColumn("_salt", F.pmod(F.col("row_no"), F.col("_parts")).cast("int"))
    copies = parts(one_each).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return salted.drop("_parts").join(copies.drop("_parts"), ["_key", "_salt"]).drop("_salt")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per changed field. before: a snapshot with row_no; after: edited rows (source and fields) with row_no from 0.

    Rows match by source, else by place; of rows with one source the first of the snapshot counts; unmatched rows are left out. The first is found
    by partial sums, and edited rows of one source beyond SPLIT are dealt to several tasks.
    """
    kept = F.struct(F.col("source").alias("_source"), *(F.struct(F.col(f).alias("o"), F.col(f"{f}_conf").alias("c")).alias(f"_{f}") for f in FIELDS))
    first = _keyed(before).groupBy("_key").agg(F.min_by(kept, "row_no").alias("_first")).select("_key", "_first.*")
    both = _join_frequent(_keyed(after), first)
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), clean(F.col(f"_{f}")["o"]).alias("original"), clean(F.col(f)).alias("corrected"), F.coalesce(F.col(f"_{f}")["c"], F.lit(0.0)).alias("original_confidence")) for i, f in enumerate(FIELDS)))
    long = both.select(F.coalesce("_source", F.lit("")).alias("source"), (F.col("row_no") + 2).cast("int").alias("excel_row"), F.inline(each))
    changed = long.filter(F.col("original") != F.col("corrected"))
    return changed.select("source", "field", "original", "corrected", "original_confidence", kind(F.col("original"), F.col("corrected")).alias("kind"), "excel_row", F.col("i").alias("field_no"))


def counts_by_field(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def statistics(corrections: DataFrame) -> DataFrame:
    """Per field, in the fields' order: corrections in all and of each kind, and the mean confidence of what was corrected."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    out = corrections.groupBy("field").agg(F.count("*").alias("total"), n("fix"), n("fill"), n("clear"), F.avg("original_confidence").alias("avg_conf"))
    order = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    return out.withColumn("field_no", order.cast("int")).filter("field_no > 0").orderBy("field_no")


def top_patterns(corrections: DataFrame, k: int, width: int = 40) -> DataFrame:
    """The k most frequent changes of beginnings of values; ties by first appearance (column seq)."""
    own = corrections.groupBy("field", F.substring("original", 1, width).alias("original"), F.substring("corrected", 1, width).alias("corrected")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return own.orderBy(F.desc("n"), "seq").limit(k)


def confident_mistakes(corrections: DataFrame, k: int, least: float = CONFIDENT) -> DataFrame:
    """The k corrections of values that the parser was surest of; ties in their order (column seq)."""
    return corrections.filter(F.col("original_confidence") >= least).orderBy(F.desc("original_confidence"), "seq").limit(k)
