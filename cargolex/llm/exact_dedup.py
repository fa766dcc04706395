"""Exact dedup by two passes over Bloom filters, by expressions alone.

The first pass sets two slots of a filter for the hash of each text and counts, by partial sums, which slots are set again; those
slots are the second filter, a bitmap of at most `MAX_SLOTS` bits that every task gets. The second pass asks it: a row with a slot
that is set once has no equal and passes straight through, and only the other rows, whose hashes may be repeated, are shuffled. What
the filter lets through in error is told apart by the SHA-256 of the text, so its size bears on the work, never on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, texts

#: Slots for each row, a power of two and at least one block; 2^30 of them are 128 MB. Beyond 64 million rows the filter gets fuller
#: and lets more rows through, beyond a billion nearly all.
SLOTS_A_ROW, MAX_SLOTS = 16, 1 << 30
#: Both slots of a hash lie in one block, a bitmap of 4 KB as bitmap_construct_agg makes it.
BLOCK = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fingerprint(text: Column) -> Column:
    """SHA-256, as 32 bytes, of a text with A-Z alone lower-cased; a null text is empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def _block(sha: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(slots // BLOCK))


def _offsets(sha: Column) -> tuple[Column, Column]:
    """The two slots of a hash in its block, from bits that do not choose the block."""
    h = F.xxhash64(sha)
    return F.shiftrightunsigned(h, 49).cast("int"), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BLOCK - 1)).cast("int")


def slots_for(rows: int) -> int:
    return min(MAX_SLOTS, max(BLOCK, 1 << (SLOTS_A_ROW * max(rows, 1) - 1).bit_length()))


def set_again(hashes: DataFrame, slots: int) -> DataFrame:
    """(block, bits): the slots that two rows or more have set. hashes: column sha."""
    one, two = _offsets(F.col("sha"))
    seen = hashes.select(_block(F.col("sha"), slots).alias("block"), F.explode(F.array_distinct(F.array(one, two))).alias("at"))
    again = seen.groupBy("block", "at").agg(F.count("*").alias("n")).filter("n > 1")
    return again.groupBy("block").agg(F.expr("bitmap_construct_agg(cast(at as bigint))").alias("bits"))


def maybe_repeated(rows: DataFrame, again: DataFrame, slots: int) -> DataFrame:
    """rows (with a column sha) and _maybe: whether both slots are set again. The broadcast is slots / 8 bytes at most."""

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), at.bitwiseAND(F.lit(7)) + 1)) > 0

    one, two = _offsets(F.col("sha"))
    filtered = F.broadcast(again.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    out = rows.join(filtered, _block(F.col("sha"), slots) == F.col("_block"), "left")
    return out.withColumn("_maybe", F.coalesce(is_set(one) & is_set(two), F.lit(False))).drop("_block", "_bits")


def equal_texts(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, keep_id (doc_id of the row that stays of its equals), group_size, kept, text_sha256 (hex).

    Texts are equal if they are after lower-casing A-Z alone; null counts as empty. Of equals the row with the largest doc_id stays, rows
    without doc_id only among themselves, and of rows that share that doc_id exactly one. An empty table gives an empty one; further columns are
    not looked at. Texts are read once and never shuffled.
    """
    own = checkpoint(texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), fingerprint(F.col("text")).alias("sha")))
    slots = slots_for(own.count())
    flagged = maybe_repeated(own, checkpoint(set_again(own, slots)), slots)
    maybe = flagged.filter("_maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    # groups are checkpointed so that both sides of the join are plain shuffles, of which large ones can be split
    found = maybe.join(checkpoint(groups), "sha", "left")
    single = F.col("n").isNull()
    shuffled = found.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("keep.row"))).alias("kept"), "sha")
    passed = flagged.filter("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return shuffled.union(passed).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows of which an equal one stays; all columns pass through, whatever their names.

    Rows whose text is not repeated pass straight through; the others are brought together by partial aggregates, so that of a group
    of copies each task sends one row.
    """
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), fingerprint(F.col("text").cast("string")).alias("sha"))
    hashes = checkpoint(own.select("sha"))
    slots = slots_for(hashes.count())
    flagged = maybe_repeated(own, checkpoint(set_again(hashes, slots)), slots)
    best = flagged.filter("_maybe").groupBy("sha").agg(F.max_by("_row", F.struct(F.col("_id").isNotNull(), "_id")).alias("_row"))
    rows = flagged.filter("not _maybe").select("_row").union(best.select("_row"))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
