"""Ranked lexical search by Fagin's threshold algorithm over an index that Spark builds and keeps in parts.

A scan of the texts writes a forward index: of each document its number of terms, and the terms that any item may ask for with their
counts. Sums over it give the corpus' figures. A task of the search reads some rows of the index at a time, sorts the impacts of each
term's postings, and for each item reads its lists in turn from the top, looks every new document up in the forward
index, and stops as soon as no document further down can reach the k-th best score any more. The best of the rows before are kept, so
later rows start from a high k-th score; the k best of each task and item go into one last ranking.

Terms are 64-bit hashes of lower-cased bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as v
from .common import checkpoint, stored, texts

#: Bits of the filter of terms asked for that the scan consults: 2 MB however many items there are.
FILTER_BITS = 1 << 24
#: Pairs of item and term that one search takes at once (some 8 MB); more items are searched for in blocks.
BLOCK_TERMS = 1 << 18
#: Postings that a task sorts at once, and entries of each list that it reads before it looks at the threshold, at first.
SHARD, STEP = 1 << 20, 32
NO_ID = np.iinfo(np.int64).max

_INDEX = "doc_id long, n long, terms array<long>, tfs array<long>"


def _scan(wanted):
    """Kernel of (doc_id, text) to the forward index. wanted: the filter, or None for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text"):
                _, _, row, h = v.words(data, bounds, v.ALNUM)
                counts = np.bincount(row, minlength=len(part)).astype(np.int64)
                if wanted is not None:
                    bit = h & v.U(FILTER_BITS - 1)
                    keep = (wanted.value[(bit >> v.U(3)).astype(np.int64)] >> (bit & v.U(7)).astype(np.uint8)) & 1 == 1
                    row, h = row[keep], h[keep]
                term = h.view(np.int64)
                order = np.lexsort((term, row))
                row, term = row[order], term[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[first, len(row)])
                each = np.bincount(row[first], minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), v.lists(term[first], each, pa.int64()), v.lists(tf, each, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    return run


def _filter(terms: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS bits of the terms asked for, as bytes; what is collected is bounded by it."""
    bit = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = terms.groupBy(F.shiftright(bit, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 31 as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return words.view(np.uint8)


class Shard:
    """Postings of some documents: sorted by document and term (the forward index), and by term and falling impact (the lists)."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.n_terms = ids, n_terms
        key = doc * n_terms + term
        order = np.argsort(key, kind="stable")
        self.keys, self.impacts = key[order], impact[order]
        order = np.lexsort((-impact, term))
        self.docs, self.sorted = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def look_up(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents."""
        want = docs[:, None] * self.n_terms + terms
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.impacts[at], 0) @ times

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these documents and of those that came before (scores and ids, best first)."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        seen = np.zeros(len(self.ids), bool)
        depth, step = 0, STEP
        while True:
            met = [self.docs[a + depth : min(a + depth + step, b)] for a, b in zip(starts, ends, strict=True) if a + depth < b]
            if not met:
                return scores, ids
            new = np.unique(np.concatenate(met))
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                scores, ids = np.r_[scores, self.look_up(new, terms, times)], np.r_[ids, self.ids[new]]
                order = np.lexsort((ids, -scores))[:k]
                order = order[scores[order] > 0]
                scores, ids = scores[order], ids[order]
            depth += step
            step *= 2
            last = starts + depth - 1
            # an unseen document has at most the impact last read in each list, and none in a list that is read to its end
            threshold = int(np.where(last < ends, self.sorted[np.minimum(last, len(self.sorted) - 1)], 0) @ times)
            if threshold == 0 or len(scores) == k and threshold < scores[-1]:
                return scores, ids


def _search(asked, corpus: tuple[int, int], k: int):
    """Kernel of index rows to (item, doc_id, score): the k best of the task. asked: arrays item, term, times, weight, by item."""
    n_docs, n_all = corpus

    def shards(batches: Iterator[pa.RecordBatch], terms: np.ndarray, weights: np.ndarray) -> Iterator[Shard]:
        kept: list[tuple] = []
        docs = size = 0

        def built() -> Shard:
            return Shard(*(np.concatenate([x[i] for x in kept]) for i in range(4)), len(terms))

        for batch in batches:
            n = batch.column(1).to_numpy()
            lists = batch.column(2)
            tf = batch.column(3).flatten().to_numpy()
            term = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
            hit = terms[at] == term
            doc, at, tf = doc[hit], at[hit], tf[hit]
            own = n[doc]
            if len(own) and 75 * int(own.max()) * n_docs >= 1 << 63:
                share = np.array([75 * int(x) * n_docs // n_all for x in own], np.int64)
            else:
                share = 75 * own * n_docs // max(n_all, 1)
            impact = weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * (25 + share)))
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy()
            kept.append((ids, doc + docs, at, impact))
            docs, size = docs + len(ids), size + len(at)
            if size >= SHARD:
                yield built()
                kept, docs, size = [], 0, 0
        if size:
            yield built()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, times, weight = asked.value
        terms, where = np.unique(term, return_index=True)
        weights = weight[where]
        at = np.searchsorted(terms, term)
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        spans = list(zip(item[cuts], cuts, np.r_[cuts[1:], len(item)], strict=True))
        none = np.zeros(0, np.int64)
        best = {i: (none, none) for i, _, _ in spans}
        for shard in shards(batches, terms, weights):
            for i, a, b in spans:
                best[i] = shard.best(at[a:b], times[a:b], k, *best[i])
        counts = np.array([len(best[i][0]) for i in best])
        if counts.sum():
            ids = np.concatenate([x[1] for x in best.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best)), counts)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([x[0] for x in best.values()]))], ["item", "doc_id", "score"]
            )

    return run


def index(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The forward index of all rows, written beside the checkpoints: doc_id, n (terms with repeats), terms, tfs."""
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    return stored(texts(docs).mapInArrow(_scan(sent), _INDEX))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, none with score 0; equal scores by ascending doc_id.

    Each row of items is an item and each row of docs a document of its own, so rows that stand several times are ranked several times. Rows
    without doc_id come last among equal scores. Null and wordless texts have no terms: such items get no rows, such documents are never found and not
    counted. An empty table on either side gives no rows. Further columns are not looked at.
    """
    spark = docs.sparkSession
    rows = checkpoint(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")))
    own = rows.select(F.col("item").alias("doc_id"), "text").mapInArrow(_scan(None), _INDEX)
    own = checkpoint(own.select(F.col("doc_id").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")))
    found = index(docs, _filter(own))
    n_docs, n_all = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    asked = checkpoint(own.join(df, "term").select("item", "term", "times", weight.alias("weight")).filter("weight > 0"))
    n_blocks = -(-asked.count() // BLOCK_TERMS)
    tops = None
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
        if part.num_rows:
            arrays = tuple(part.column(c).to_numpy() for c in ("item", "term", "times", "weight"))
            top = found.mapInArrow(_search(spark.sparkContext.broadcast(arrays), (n_docs, n_all), k), "item long, doc_id long, score long")
            tops = top if tops is None else tops.union(top)
    if tops is None:
        return rows.filter("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
