"""Line dedup by site-relative frequency.

A line is boilerplate of its host if the share of the host's pages that hold it exceeds a ratio. Pages are
counted with partial sums, so a host of a third of all pages is no heavier for one task than any other. A host has
at most (its mean lines a page / ratio) boilerplate lines, whatever its number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Up to so many (host, line) hashes of 16 bytes are broadcast; more are joined by host.
BROADCAST_ROWS = 100_000

_BLANK = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """64-bit hash of a line without the white space around it; null if nothing is left."""
    core = F.regexp_replace(line, rf"^{_BLANK}|{_BLANK}$", "")
    return F.when(core != "", F.xxhash64(core))


def boilerplate(docs: DataFrame, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line hash) of the lines on over max_ratio of the host's pages and on min_pages of them at least."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), "text")
    totals = pages.groupBy("_host").agg(F.count("*").alias("n_pages"))
    once = pages.select("_host", F.explode(F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: k.isNotNull()))).alias("_line"))
    counted = once.groupBy("_host", "_line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counted.join(totals, "_host").filter(F.col("n") > F.col("n_pages") * max_ratio).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with `text` cut to its other lines, and `n_lines`, `n_dropped` (long) added (taking the place of such columns).

    Lines are parted by \\n and compared without the white space around them; blank lines stay and never count. A line
    counts once a page. A null text has no lines and stays null, null hosts are one host, repeated rows are pages of
    their own, an empty table gives an empty one. All other columns pass through untouched.
    """
    marked = checkpoint(boilerplate(docs, host, max_ratio, min_pages))
    sets = marked.groupBy("_host").agg(F.collect_list("_line").alias("_set"))
    if marked.count() <= BROADCAST_ROWS:
        sets = F.broadcast(sets)
    # the input's own columns go along inside one struct, so that none of theirs can clash with those of the operator
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col("text").alias("_text")).join(sets, "_host", "left")
    lines = _lines(F.col("_text"))
    kept = F.when(F.col("_set").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_set", _key(x)), F.lit(False))))
    there = F.col("_text").isNotNull()
    out = out.withColumn("_kept", kept).withColumn("_n", F.size(lines))
    made = {"text": F.when(there, F.array_join("_kept", "\n")), "n_lines": F.when(there, F.col("_n")).otherwise(0).cast("long"), "n_dropped": F.when(there, F.col("_n") - F.size("_kept")).otherwise(0).cast("long")}
    rest = [c for c in docs.columns if c not in made or c == "text"]
    return out.select(*(made[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in rest), *(made[c].alias(c) for c in ("n_lines", "n_dropped")))
