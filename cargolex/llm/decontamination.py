"""Benchmark decontamination by winnowing.

Both sides keep the smallest `GRAM`-word hash of every sliding window of `WINDOW - GRAM + 1` grams. Two equal windows
of `WINDOW` words pick the same gram, so these fingerprints miss none; a hit is extended to all windows around its gram. Items of fewer
words are one window of that length.

What is joined are the contents of windows, each once: a sentence that stands in many items and many documents gives a row for each place
in a document, never one for each document and item. Which items a window stands in is a list that all its documents share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as v
from .common import checkpoint, texts

WINDOW, GRAM = 10, 5
#: Bits of each filter that the scan of the documents consults: 2 MB at any size of the benchmark.
FILTER_BITS = 1 << 24
BEFORE = WINDOW - GRAM
_OTHER = v.U(0x9E3779B97F4A7C15)

_HIT = pa.struct([("span", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32())])
_SCHEMA = "doc_id long, n_words long, hits array<struct<span:int, k1:long, k2:long, start:int>>, prints array<long>"


def _winnowed(grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Positions of the rightmost smallest gram of each window that starts at one of `windows`."""
    best, at = grams[windows], windows.copy()
    for o in range(1, BEFORE + 1):
        now = grams[windows + o]
        less = now <= best
        best[less] = now[less]
        at[less] = windows[less] + o
    return np.unique(at)


def _keys(h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the content of each window of n words, as two numbers."""
    own = h[starts[:, None] + np.arange(n)].ravel()
    first = np.arange(len(starts)) * n
    if not len(starts):
        return np.zeros(0, v.U), np.zeros(0, v.U)
    return v.grams(own, n)[first], v.grams(v.mix(own ^ _OTHER), n)[first]


def _kernel(filters):
    """Scan of (doc_id, text) for windows. filters: bitmaps by length of window, and of grams under 0; None: the rows are items, all of whose
    windows and fingerprints are told."""

    def passes(which: int, key: np.ndarray) -> np.ndarray:
        if which not in filters.value:
            return np.zeros(len(key), bool)
        bit = key & v.U(FILTER_BITS - 1)
        return (filters.value[which][(bit >> v.U(3)).astype(np.int64)] >> (bit & v.U(7)).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text"):
                _, _, row, h = v.words(data, bounds, v.ALNUM)
                counts = np.bincount(row, minlength=len(part)).astype(np.int64)
                first = np.cumsum(counts) - counts
                found, prints = [], np.zeros(0, np.int64)

                def add(n, starts, found=found, h=h):
                    k1, k2 = _keys(h, starts, n)
                    keep = slice(None) if filters is None else passes(n, k1)
                    found.append((np.full(len(starts), n, np.int32)[keep], k1[keep], k2[keep], starts[keep]))

                if len(h) >= WINDOW:
                    whole = row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :]
                    g = v.grams(h, GRAM)
                    at = _winnowed(g, np.flatnonzero(whole))
                    if filters is None:
                        prints = at
                        add(WINDOW, np.flatnonzero(whole))
                    else:
                        at = at[passes(0, g[at])]
                        starts = np.unique(at[:, None] - np.arange(BEFORE + 1))
                        starts = starts[(starts >= 0) & (starts < len(whole))]
                        add(WINDOW, starts[whole[starts]])
                for n in range(1, WINDOW):
                    if filters is None:
                        add(n, first[counts == n])
                    elif n in filters.value and len(h) >= n:
                        hit = (row[: len(h) - n + 1] == row[n - 1 :]) & passes(n, v.grams(h, n))
                        add(n, np.flatnonzero(hit))
                span, k1, k2, start = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int32 if i == 0 else np.int64) for i in range(4))
                order = np.argsort(row[start], kind="stable") if len(start) else np.zeros(0, np.int64)
                of = row[start][order] if len(start) else np.zeros(0, np.int64)
                hits = pa.StructArray.from_arrays([pa.array(span[order]), pa.array(k1[order].view(np.int64)), pa.array(k2[order].view(np.int64)), pa.array((start[order] - first[of]).astype(np.int32))], fields=list(_HIT))
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum(np.bincount(of, minlength=len(part)), out=offsets[1:])
                told = v.lists(g[prints].view(np.int64) if len(prints) else prints, np.bincount(row[prints] if len(prints) else prints, minlength=len(part)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), hits), told], ["doc_id", "n_words", "hits", "prints"])

    return run


def _filters(keys: DataFrame) -> dict[int, np.ndarray]:
    """For each `which` a bitmap of its keys (which int, key long): FILTER_BITS bits, however many there are."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = keys.groupBy("which", F.shiftright(bit, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 31 as int))")).alias("bits")).toArrow()
    out: dict[int, np.ndarray] = {}
    which, w, bits = (rows.column(k).to_numpy() for k in range(3))
    for n in np.unique(which):
        words = np.zeros(FILTER_BITS // 32, np.uint32)
        words[w[which == n]] = bits[which == n].astype(np.uint32)
        out[int(n)] = words.view(np.uint8)
    return out


def matched_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every document; (row, start, span, list) of every place of a window of an item in one; (list, item_ids): the
    items that hold a window."""
    spark = docs.sparkSession
    tested = checkpoint(items.select(F.monotonically_increasing_id().alias("doc_id"), "item_id", F.col("text").cast("string").alias("text")))
    own = checkpoint(tested.select("doc_id", "text").mapInArrow(_kernel(None), _SCHEMA))
    windows = own.select(F.col("doc_id"), F.inline("hits")).join(tested.select("doc_id", "item_id"), "doc_id")
    windows = checkpoint(windows.groupBy("span", "k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    lists = checkpoint(windows.select("item_ids").distinct().select(F.monotonically_increasing_id().alias("list"), "item_ids"))
    windows = checkpoint(windows.join(lists, "item_ids").select("span", "k1", "k2", "list"))
    filters = _filters(windows.select(F.col("span").alias("which"), F.col("k1").alias("key")).union(own.select(F.lit(0), F.explode("prints"))))
    scanned = texts(docs).mapInArrow(_kernel(spark.sparkContext.broadcast(filters)), _SCHEMA).drop("prints")
    scanned = checkpoint(scanned.select(F.monotonically_increasing_id().alias("row"), "*"))
    hits = scanned.select("row", F.inline("hits")).join(windows, ["span", "k1", "k2"]).select("row", "start", "span", "list")
    return scanned.select("row", "doc_id", "n_words"), hits, lists


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_words, n_hit (words inside any window of an item), item_ids (sorted array), contaminated.

    Null and wordless texts have no words; such items match nothing. Repeated items and ties count once, an empty
    table on either side leaves all documents clean, and further columns are not looked at. Each row has its own result, also where rows share
    a doc_id or have none. Items without item_id hit, but are not listed.
    """
    words, hits, lists = matched_windows(docs, items)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "span"))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], (x["start"] + x["span"]).cast("long")).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["span"] - F.greatest(acc["end"], x["start"].cast("long")))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    found = checkpoint(hits.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("list")).alias("of")))
    # documents with the same windows share the union of their lists, which is made once
    each = found.select("of").distinct().select("of", F.explode("of").alias("list")).join(lists, "list")
    unions = each.groupBy("of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    out = words.join(found.join(unions, "of").select("row", "n_hit", "item_ids"), "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
