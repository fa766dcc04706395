"""Dedup of repeated byte strings by distributed prefix doubling.

Names of 2, 4, ... 64 bytes at every position are doubled inside each text, where no other row is needed. Spark sorts
runs of positions by rank pairs, at growing lengths of the name that a run shares: 32 bytes, 83 bytes, then the whole SPAN.
In round one neighbouring positions whose strings of SPAN bytes hold one and the same smallest 32-byte name are one run, so a
text has a run for about 35 bytes, and equal strings always lie in different runs of one name. After each sort, runs of a unique name
fall out, runs that repeat an earlier one are settled whole, and only those of one name and different content are ranked again by
a longer name. The sort's key ends with the position, so rows of one frequent string are dealt over as many tasks as they need.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as v
from .common import checkpoint, stored, texts

SPAN = 100
_NAME = 32


def _doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of 32 and of 64 bytes at every position that has as many after it."""
    name, size, short = v.BYTE[data], 1, None
    while size < 2 * _NAME:
        name = name[: max(len(name) - size, 0)] * v.U(0x9E3779B97F4A7C15) + name[size:]
        name ^= name >> v.U(29)
        name *= v.U(0xBF58476D1CE4E5B9)
        name ^= name >> v.U(32)
        size *= 2
        if size == _NAME:
            short = name
    return short, name


def _pair(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return names[at], names[at + SPAN - 2 * _NAME]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return v.mix(a * v.U(0x9E3779B97F4A7C15) + b)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` values on."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


_RUNS = "m long, c long, doc_id long, at int, n int"


def _runs(batches):
    """Runs of (doc_id, text): smallest name, content, first position and number of positions."""
    width = SPAN - _NAME + 1
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "text"):
            if len(data) < SPAN:
                continue
            short, names = _doubled(data)
            least = _least(short, width)
            ok = np.ones(len(least), bool)
            near = (bounds[1:, None] - np.arange(1, SPAN)).ravel()
            ok[near[(near >= 0) & (near < len(ok))]] = False
            # a run ends where the first of its smallest names falls out, so no run holds a string twice
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (short[: len(least) - 1] == least[:-1])
            s = np.flatnonzero(new)
            if not len(s):
                continue
            n = np.flatnonzero(ok & np.append(~ok[1:] | new[1:], True)) + 1 - s
            c = _join(_join(*_pair(names, s)), _join(*_pair(names, s + n - 1))) + n.astype(v.U)
            row = np.searchsorted(bounds, s, "right") - 1
            ids = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(least[s].view(np.int64)), pa.array(c.view(np.int64)), ids, pa.array((s - bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "c", "doc_id", "at", "n"])


#: What a sorted run is: one that repeats an earlier run, one to rank again, one that a neighbouring partition decides on.
LATER, AGAIN, EDGE = 0, 1, 2


def _neighbours(batches):
    """Over a partition of sorted runs: all but those alone with their content and name, with their kind. Holds one run from batch to batch."""
    last, pending, started = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        m, c = (np.asarray(batch.column(i)) for i in (0, 1))
        named = np.empty(len(m), bool)  # same name as the run before
        named[1:], named[0] = m[1:] == m[:-1], last is not None and m[0] == last[0]
        same = named.copy()
        same[1:] &= c[1:] == c[:-1]
        same[0] &= last is not None and c[0] == last[1]
        changed = named & ~same
        group = np.cumsum(~named)
        several = np.bincount(group, changed, group[-1] + 1) > 0
        kind = np.where(same, LATER, np.where(changed | several[group], AGAIN, -1))
        if pending is not None:
            if several[0]:
                yield _kinds(pending, np.zeros(1, np.int64), np.full(1, AGAIN))
            if several[0] or group[-1] > 0:
                pending = None
        head = int(np.flatnonzero(group == group[-1])[0])
        if not named[head] and not several[-1]:
            pending = batch.slice(head, 1)
        if not started:  # the first run of the partition, and what it is followed by
            kind[0], started = EDGE, True
            if head == 0:
                pending = None
        keep = np.flatnonzero(kind >= 0)
        yield _kinds(batch, keep, kind[keep])
        last = m[-1], c[-1]
    if pending is not None:
        yield _kinds(pending, np.zeros(1, np.int64), np.full(1, EDGE))


def _kinds(batch, rows, kind):
    out = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(kind.astype(np.int32))], [*out.schema.names, "kind"])


def _snippets(batches):
    """Of (doc_id, text, spans) a row for each span: its first position, number of positions, and their bytes."""
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "text"):
            spans = part.column(2)
            count = np.asarray(spans.value_lengths())
            flat = spans.flatten()
            at, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            start = at + np.repeat(bounds[:-1], count)
            whole = data.tobytes()
            own = [whole[x:y] for x, y in zip(start.tolist(), (start + n - 1 + SPAN).tolist(), strict=True)]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), count)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())], ["doc_id", "at", "n", "own"])


_PARTS = "m long, c long, doc_id long, at int, n int, own binary"


def _parts(batches):
    """Runs cut in four by the offset of the smallest name, so that all positions of a part share _LONG bytes around it."""
    width = SPAN - _NAME + 1
    step = -(-width // 4)
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "own"):
            short, names = _doubled(data)
            first = bounds[:-1]
            x = np.argmin(short[first[:, None] + np.arange(width)], axis=1)
            n = np.asarray(part.column(2)).astype(np.int64)
            keys, contents, rows, ats, ns = [], [], [], [], []
            for k in range(4):
                low, high = np.maximum(x - n + 1, step * k), np.minimum(x, min(step * (k + 1), width) - 1)
                has = np.flatnonzero(low <= high)
                core = (first + x - step * k)[has]
                keys.append(_join(names[core], names[core + SPAN - step + 1 - 2 * _NAME]) + v.U(k))
                s, m = (x - high)[has], (high - low + 1)[has]
                ends = first[has] + s
                contents.append(_join(_join(*_pair(names, ends)), _join(*_pair(names, ends + m - 1))) + m.astype(v.U))
                rows.append(has)
                ats.append(s)
                ns.append(m)
            row, s, m = np.concatenate(rows), np.concatenate(ats), np.concatenate(ns)
            yield _cut_out(part, data, first[row] + s, row, s, m, np.concatenate(keys), np.concatenate(contents))


def _cut_out(part, data, start, row, s, n, m, c):
    whole = data.tobytes()
    own = [whole[x:y] for x, y in zip(start.tolist(), (start + n - 1 + SPAN).tolist(), strict=True)]
    at = np.asarray(part.column(1))[row] + s
    return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())], ["m", "c", "doc_id", "at", "n", "own"])


def _strings(batches):
    """Single positions of the parts, named by all their SPAN bytes."""
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "own"):
            _, names = _doubled(data)
            n = np.asarray(part.column(2)).astype(np.int64)
            row = np.repeat(np.arange(len(part)), n)
            s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = _pair(names, bounds[:-1][row] + s)
            ids, at = part.column(0).take(pa.array(row)), np.asarray(part.column(1))[row] + s
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), ids, pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int32))], ["m", "c", "doc_id", "at", "n"])


def _cut(batches, with_bytes=True):
    """Texts without the spans: counts and the SHA-256 of what stays."""
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "text"):
            n_bytes = np.diff(bounds)
            removed, runs, shas, kept = [], [], [], []
            for i, spans in enumerate(part.column(2)):
                own = data[bounds[i] : bounds[i + 1]]
                if spans.is_valid and len(spans.values):
                    at = np.asarray(spans.values.field(0)).astype(np.int64)
                    step = np.zeros(len(own) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + np.asarray(spans.values.field(1)) - 1 + SPAN, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    runs.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                    removed.append(int(gone.sum()))
                    own = own[~gone]
                else:
                    runs.append(0)
                    removed.append(0)
                own = own.tobytes()
                kept.append(own if with_bytes else None)
                shas.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _ranked(runs: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Sorts runs by rank pair and position: the spans that repeat an earlier run, and the runs to rank again (first of their content)."""
    order = ["m", "c", "doc_id", "at"]
    settled = stored(runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, schema + ", kind int"))
    # two runs of a partition at most are left open, so this side is as small as the number of partitions
    edges = F.broadcast(settled.filter(F.col("kind") == EDGE).select("m").distinct())
    near = settled.filter(F.col("kind") != LATER).join(edges, "m").withColumn("place", F.struct("doc_id", "at"))
    first = near.groupBy("m", "c").agg(F.min("place").alias("first"))
    counts = first.groupBy("m").agg(F.count("*").alias("contents"))
    decided = near.filter(F.col("kind") == EDGE).join(first, ["m", "c"]).join(counts, "m")
    later = settled.filter(F.col("kind") == LATER).select("doc_id", "at", "n").union(decided.filter(F.col("place") != F.col("first")).select("doc_id", "at", "n"))
    rest = [x for x in settled.columns if x not in ("m", "c", "kind")]
    again = settled.filter(F.col("kind") == AGAIN).select(rest).union(decided.filter((F.col("place") == F.col("first")) & (F.col("contents") > 1)).select(rest))
    return later, again


def repeated_spans(docs: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """(doc_id, at, n): at at.. at+n-1 start strings of SPAN bytes that start earlier too (smaller doc_id, or before in the document).

    Rows without doc_id are left out, and of rows with one doc_id the first text by order stands for it.
    """
    source = texts(docs).filter(F.col("doc_id").isNotNull())
    twice = _repeated_ids(docs) if twice is None else twice
    if not twice.isEmpty():
        stands = source.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        source = source.join(twice, "doc_id", "left_anti").unionByName(stands)
    found, again = _ranked(source.mapInArrow(_runs, _RUNS), _RUNS)
    spans = again.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    snippets = stored(source.join(spans, "doc_id").mapInArrow(_snippets, "doc_id long, at int, n int, own binary"))
    more, again = _ranked(snippets.mapInArrow(_parts, _PARTS), _PARTS)
    most, _ = _ranked(again.select("doc_id", "at", "n", "own").mapInArrow(_strings, _RUNS), _RUNS)
    return found.union(more).union(most)


def _repeated_ids(docs: DataFrame) -> DataFrame:
    """The ids of more than one row; a shuffle of ids alone."""
    return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))


def cut_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes (remaining bytes, which may part a character; null if not asked for).

    A null text is empty; texts under SPAN bytes and an empty table lose nothing; of copies the first keeps its text; other columns are not looked at.
    Rows that stand several times are one document and get the same result; of different texts under one doc_id the first by order is that document, and
    the others, as well as rows without doc_id, lose nothing.
    """
    twice = _repeated_ids(docs)
    spans = repeated_spans(docs, twice).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    rows = texts(docs).join(spans, "doc_id", "left")
    if not twice.isEmpty():
        stands = texts(docs).join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.xxhash64(F.min(F.coalesce("text", F.lit("")))).alias("_first"))
        same = F.coalesce(F.col("_first") == F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(True))
        rows = rows.join(stands, "doc_id", "left").select("doc_id", "text", F.when(same, F.col("spans")).alias("spans"))
    return rows.mapInArrow(partial(_cut, with_bytes=with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
