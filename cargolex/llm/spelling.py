"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped under the most frequent form.

Two words that are near agree before their first difference and behind it. Every half of a word is a key: an edit in the second half keeps
the first half, one in the first half keeps the second half, so Spark deals words to shards by their halves and each pair meets in one
shard. There the words of one length are sorted forward and reversed, and a wavelet tree holds the reverse rank of each forward
rank. For each edit position a word's prefix is an interval of the forward order, its suffix one of the reverse order, and the tree reports
the words in both. Counts and best forms are settled in the shard, so that no list of pairs is shuffled.

Words are Latin-1 bytes, one byte a code point, as their alphabet ends at U+00FF.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as v
from .common import checkpoint, texts

LEAST_LENGTH, LEAST_N, RATIO, DELETE_EVERY = 7, 2, 10, 31
#: Words of one key that one shard indexes or asks for; keys of more are dealt to a square of shards. Rows that a task gets at most, about.
SHARD, TASK_ROWS = 200_000, 500_000
#: Runs up to this length are hashed side by side.
SHORT = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all letters, 0 for whatever parts runs, lower-cased; first and end of each run in them, and its row."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1] & (data[1:] & 0xC0 == 0x80)
    value = np.where(_LETTER[data], v.LOWER[data], 0).astype(np.uint8)
    value[:-1][lead[:-1]] = data[1:][lead[:-1]] + 0x40
    symbols = value[~tail]
    edges = bounds - np.r_[0, np.cumsum(tail)][bounds]
    w = np.zeros(len(symbols) + 2, bool)
    w[1:-1] = symbols != 0
    edge = np.zeros(len(symbols) + 1, bool)
    edge[edges] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | edge[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | edge[1:])) + 1
    return symbols, starts, ends, np.searchsorted(edges, starts, "right") - 1


def _crcs(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of what was begun (its CRC) and the run's UTF-8 bytes."""
    order = np.argsort(-lengths, kind="stable")
    state, first, n = ~begun[order], starts[order], lengths[order]
    long = np.searchsorted(-n, -SHORT, "left")
    for j in range(int(n[long]) if long < len(n) else 0):
        to = np.searchsorted(-n, -j, "left")
        c = symbols[first[long:to] + j].astype(np.uint32)
        now = state[long:to]
        wide = c >= 0x80
        byte = np.where(wide, np.uint32(0xC3), c)
        now = _CRC[(now ^ byte) & np.uint32(255)] ^ (now >> np.uint32(8))
        if wide.any():
            x = now[wide]
            now[wide] = _CRC[(x ^ (c[wide] - np.uint32(0x40))) & np.uint32(255)] ^ (x >> np.uint32(8))
        state[long:to] = now
    out = np.empty(len(n), np.uint32)
    out[order] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(symbols[starts[i] : starts[i] + lengths[i]].tobytes().decode("latin-1").encode(), int(begun[i]))
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), words of a piece once."""
    for batch in batches:
        for part, data, bounds in v.pieces(batch, "text", 2 * v.PIECE):
            symbols, starts, ends, row = _runs(data, bounds)
            long = ends - starts >= LEAST_LENGTH
            starts, row, lengths = starts[long], row[long], (ends - starts)[long]
            begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column(0).to_pylist()], np.uint32)
            h = _crcs(symbols, starts, lengths, begun[row])
            hit = h % DELETE_EVERY == 0
            first = np.cumsum(lengths) - lengths
            flat = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
            stays = np.ones(len(flat), bool)
            stays[(first + h % lengths)[hit]] = False
            own, n = symbols[flat[stays]], lengths - hit
            ends = np.cumsum(n)
            starts, ends = (ends - n)[n >= LEAST_LENGTH], ends[n >= LEAST_LENGTH]
            up, down = v.powers(v.BASE, len(own) + 1)
            total = np.r_[v.U(0), np.cumsum(v.BYTE[own] * up[: len(own)], dtype=v.U)]
            keys = v.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(v.U))
            _, at, counts = np.unique(keys, return_index=True, return_counts=True)
            n = (ends - starts)[at]
            to = np.cumsum(n)
            flat = np.arange(n.sum()) + np.repeat(starts[at] - (to - n), n)
            words = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, to].astype(np.int32)), pa.py_buffer(own[flat])])
            yield pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that stand twice or more, as Latin-1."""
    each = texts(docs).mapInArrow(_count_words, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


class Wavelet:
    """Wavelet tree of a permutation in its levelwise form: at each bit, zeros keep their order in front of ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in reversed(range(self.bits)):
            one = values >> bit & 1 == 1
            zeros = np.r_[0, np.cumsum(~one)]
            self.levels.append((bit, zeros, zeros[-1]))
            values = np.r_[values[~one], values[one]]

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [c, d) at places in [a, b), for each query."""
        of, low = np.arange(len(a)), np.zeros(len(a), np.int64)
        for bit, zeros, n in self.levels:
            za, zb = zeros[a], zeros[b]
            of, low = np.r_[of, of], np.r_[low, low + (1 << bit)]
            a, b = np.r_[za, n + a - za], np.r_[zb, n + b - zb]
            keep = np.flatnonzero((a < b) & (low < d[of]) & (low + (1 << bit) > c[of]))
            of, low, a, b = of[keep], low[keep], a[keep], b[keep]
        return of, low


def _strings(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel()


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows."""
    n = min(a.shape[1], b.shape[1])
    differs = a[:, :n] != b[:, :n]
    return np.where(differs.any(axis=1), differs.argmax(axis=1), n)


class Order:
    """Words of one length in order, with the common prefixes of neighbours."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(_strings(words), kind="stable")
        self.words = words[self.order]
        self.keys = _strings(self.words)
        self.near = np.r_[-1, _common(self.words[1:], self.words[:-1]), -1]

    def place(self, asked: np.ndarray) -> Places:
        return Places(self, asked)


class Places:
    """Where words stand, or would stand, in an order."""

    def __init__(self, own: Order, asked: np.ndarray):
        n = len(own.keys)
        keys = _strings(asked)
        self.own, self.at = own, np.searchsorted(own.keys, keys)
        here = np.minimum(self.at, n - 1)
        self.itself = (self.at < n) & (own.keys[here] == keys)
        self.left = np.where(self.at > 0, _common(asked, own.words[np.maximum(self.at - 1, 0)]), -1)
        self.right = np.where(self.at < n, _common(asked, own.words[here]), -1)
        #: longest prefix that another word has
        self.most = np.maximum(self.left, np.where(self.itself, own.near[np.minimum(self.at + 1, n)], self.right))

    def interval(self, length: np.ndarray | int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words `which`: the interval that shares their first `length` code points (one number)."""
        cuts = np.flatnonzero(self.own.near < length)
        at = self.at[which]
        a = np.where(self.left[which] >= length, cuts[np.searchsorted(cuts, np.maximum(at - 1, 0), "right") - 1], at)
        b = np.where(self.right[which] >= length, cuts[np.minimum(np.searchsorted(cuts, at, "right"), len(cuts) - 1)], at)
        return a, b


class Index:
    """Words of one length: forward and reverse order, and the tree of reverse ranks by forward rank."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.forward, self.reverse = Order(words), Order(words[:, ::-1])
        rank = np.empty(len(words), np.int64)
        rank[self.reverse.order] = np.arange(len(words))
        self.tree = Wavelet(rank[self.forward.order])
        self.by_rank = self.reverse.order

    def near(self, asked: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(asked, word) whose first difference is at a position in [low, high): replaced where both are as long, inserted into the asked word
        where that is one shorter."""
        own, n = self.forward.words, asked.shape[1]
        longer = own.shape[1] - n
        front, back = self.forward.place(asked), self.reverse.place(asked[:, ::-1])
        # a position is open to a word if another word shares what stands before it, and one what stands behind it
        first, last = np.maximum(low, n - 1 + longer - back.most), np.minimum(high - 1, front.most)
        found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.unique(np.r_[self.forward.near, front.left, front.right]):
            which = np.flatnonzero((first <= i) & (i <= last))
            if len(which):
                a, b = front.interval(i, which)
                c, d = back.interval(n - i - 1 + longer, which)
                of, rank = self.tree.report(a, b, c, d)
                q, w = which[of], self.by_rank[rank]
                differs = np.ones(len(q), bool) if i == n else self.words[w, i] != asked[q, i]
                found_q.append(q[differs])
                found_w.append(w[differs])
        return np.concatenate(found_q), np.concatenate(found_w)


def _best(of: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `of` once: how many, and the place of its best: largest count, then smallest word (a rank)."""
    order = np.lexsort((word, -count, of))
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else order
    return of[order[first]], np.diff(np.r_[first, len(of)]), order[first]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, k, cell, word, n, indexed, asked) of a task to (word, n_near, best_n, best)."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    if table is None or not len(table):
        return
    side, k, cell, n = (table.column(c).to_numpy() for c in ("side", "k", "cell", "n"))
    indexed, asked = (table.column(c).to_numpy().astype(bool) for c in ("indexed", "asked"))
    words = table.column("word").cast(pa.large_binary()).combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data, lengths = np.frombuffer(words.buffers()[2], np.uint8), np.diff(ends)
    order = np.lexsort((lengths, cell, k, side))
    group = np.flatnonzero(np.r_[True, (np.diff(side[order]) != 0) | (np.diff(k[order]) != 0) | (np.diff(cell[order]) != 0)])

    def letters(rows: np.ndarray) -> np.ndarray:
        return data[ends[rows][:, None] + np.arange(lengths[rows[0]])]

    def told(of: np.ndarray, by: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        own, counts, at = _best(of, n[by], ranks)
        return pa.RecordBatch.from_arrays([words.take(pa.array(own)).cast(pa.binary()), pa.array(counts), pa.array(n[by[at]]), words.take(pa.array(by[at])).cast(pa.binary())], ["word", "n_near", "best_n", "best"])

    for rows in np.split(order, group[1:]):
        at, half = side[rows[0]], int(k[rows[0]])
        least = 2 * half - at
        of_length = {m: rows[lengths[rows] == m] for m in range(least, least + 3)}
        trees = {}
        for m in range(least, least + 3):
            own = of_length[m][indexed[of_length[m]]]
            if len(own) and any(len(of_length.get(x, ())) for x in ((m, m - 1) if m < least + 2 else (m - 1,))):
                trees[m] = (own, Index(letters(own)))
        for m in (least, least + 1):
            own = of_length[m][asked[of_length[m]]]
            low, high = (0, m - half) if at else (half, m + 1)
            for to in (m, m + 1):
                if not len(own) or to not in trees or to == m and len(trees[m][0]) + len(own) < 3 and np.array_equal(own, trees[m][0]):
                    continue
                target, tree = trees[to]
                q, w = tree.near(letters(own), low, high)
                if len(q):
                    rank = np.empty(len(target), np.int64)
                    rank[tree.forward.order] = np.arange(len(target))
                    yield told(own[q], target[w], rank[w])
                    if to > m:
                        place = np.empty(len(own), np.int64)
                        place[np.argsort(_strings(letters(own)), kind="stable")] = np.arange(len(own))
                        yield told(target[w], own[q], place[q])


def _keys(word: Column) -> Column:
    """The halves of a word under which it meets all words near it: side (0 front, 1 back) and length of the half."""
    n = F.length(word)
    front = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)))
    back = F.array_distinct(F.array(F.ceil(n / 2), F.ceil((n - 1) / 2)))
    as_keys = lambda side, halves: F.transform(halves, lambda k: F.struct(F.lit(side).alias("side"), k.cast("int").alias("k")))
    return F.concat(as_keys(0, front), as_keys(1, back))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones."""
    keyed = words.select("word", "n", F.explode(_keys(F.col("word"))).alias("x")).select("word", "n", "x.side", "x.k")
    keyed = keyed.withColumn("key", F.when(F.col("side") == 0, F.expr("substring(word, 1, k)")).otherwise(F.expr("substring(word, length(word) - k + 1, k)")))
    hot = checkpoint(keyed.groupBy("side", "k", "key").count().filter(F.col("count") > SHARD).select("side", "k", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("parts")))
    # keys of so many words are at most 3 / SHARD of the words
    dealt = keyed.join(F.broadcast(hot) if hot.count() < 100_000 else hot, ["side", "k", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct((F.col("own") * F.col("parts") + i).alias("cell"), F.lit(True).alias("indexed"), (i == F.col("own")).alias("asked")))
    more = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own")), lambda i: F.struct((i * F.col("parts") + F.col("own")).alias("cell"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")))
    dealt = dealt.withColumn("own", own).select("side", "k", "key", "word", "n", F.explode(F.concat(cells, more)).alias("c")).select("side", "k", "key", "word", "n", "c.cell", "c.indexed", "c.asked")
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, ceil(4 * words.count() / TASK_ROWS))
    return dealt.repartition(tasks, "side", "k", "key", "cell").drop("key").mapInArrow(_shard, "word binary, n_near long, best_n long, best binary")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, which is at most `steps` away; each round doubles the stride."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, ceil(log2(max(steps, 1))))):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = checkpoint(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def group_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters up to U+00FF of 7 code points or more, with A-Z lower-cased, after the fixed corruption by the hash of row id and run
    (a null id is the empty string); they count over all texts, repeated rows as often as they stand. The form is the near word of largest count,
    ties by code points, if that is ten times the word's. Null and empty texts, and an empty table, give no words; further columns are not looked at.
    """
    words = checkpoint(vocabulary(docs))
    near = near_words(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    own = checkpoint(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= RATIO * F.col("n"), F.col("b")).alias("b")))
    own = own.select("word", "n", "n_near", F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n"))
    most = own.agg(F.max("form_n")).first()[0] or 1
    # along forms the count grows tenfold at every step
    followed = roots(own.filter("form is not null"), len(str(most)))
    out = own.join(followed, "word", "left").withColumn("root", F.coalesce("root", "word"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return out.select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")
