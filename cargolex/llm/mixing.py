"""Mixing of sources to target weights by temperature.

A source's weight is its token share to a power, normalised. The power is the largest k/1024 that meets the target
entropy (1 keeps the shares, 0 makes all sources equal), raised again where a source would be repeated
more often than allowed. The weights are then realised as a budget of tokens: each source is a random permutation of blocks,
and blocks of a random permutation of documents, read from its start as often as its quota asks.

Texts stay where they are: what a document needs is its source's quota and the one block in which that ends, so only sums by
block and the documents of these blocks are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_IDS, checkpoint

STEPS = 1024
#: Share of the largest possible entropy that the mix shall have, and passes over a source at most.
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
BLOCK_DOCS = 256

_SPACE = r"[^\x20\x09-\x0D]+"


def _number(*parts: Column | str, digits: int = 8) -> Column:
    """A pseudo-random number of 4 bits a digit that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def _tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(_SPACE)), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source: str = "source") -> DataFrame:
    """_source, n_docs, n_tokens (words) of each source."""
    of = docs.select(_source(source).alias("_source"), _tokens().alias("_tokens"))
    return of.groupBy("_source").agg(F.count("*").alias("n_docs"), F.sum("_tokens").alias("n_tokens"))


def _sum(rows: DataFrame, c: Column | str) -> float:
    return rows.agg(F.sum(c)).first()[0] or 0


def exponent(sources: DataFrame, budget: float = 1.0, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS) -> float:
    """Bisects the power over k/1024; each step is one sum over the table of sources."""
    shares = sources.filter(F.col("n_tokens") > 0).select((F.col("n_tokens") / F.lit(_sum(sources, "n_tokens"))).alias("p"))

    def at(k: int) -> tuple[float, float]:
        """Entropy as a share of the largest one, and passes over the source that is repeated most."""
        w = F.pow("p", F.lit(k / STEPS))
        n, s, t, least = shares.agg(F.count("*"), F.sum(w), F.sum(w * F.ln("p")), F.max(w / F.col("p"))).first()
        return (1.0, 0.0) if n < 2 else ((_ln(s) - k / STEPS * t / s) / _ln(n), budget * least / s)

    def largest(holds) -> int:
        low, high = 0, STEPS
        if holds(high):
            return high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    def smallest(holds, low: int) -> int:
        high = STEPS
        if holds(low):
            return low
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    even = largest(lambda k: at(k)[0] >= target)
    return smallest(lambda k: at(k)[1] <= repeats, even) / STEPS


def _ln(x: float) -> float:
    import math

    return math.log(x)


def _quotas(sources: DataFrame, power: float, budget: float) -> DataFrame:
    """Of each source: _blocks, whole passes over it, and the tokens of the last, unfinished one."""
    everything = _sum(sources, "n_tokens")
    weight = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(everything), F.lit(power))).otherwise(0.0)
    every_weight = _sum(sources, weight)
    quota = F.coalesce(F.floor(F.lit(budget) * F.lit(everything) * weight / F.nullif(F.lit(every_weight), F.lit(0.0))), F.lit(0))
    some = F.col("n_tokens") > 0
    out = sources.withColumn("_quota", quota)
    return out.select("_source", F.ceil(F.col("n_docs") / BLOCK_DOCS).alias("_blocks"), F.when(some, F.floor(F.col("_quota") / F.col("n_tokens"))).otherwise(0).alias("_passes"), F.when(some, F.col("_quota") % F.col("n_tokens")).otherwise(0).alias("_rest"))


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are few; beyond that the planner joins by shuffling."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def mix(docs: DataFrame, source: str = "source", budget: float = 1.0, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """docs with n_tokens, n_copies (times it is read, 0 or more) and mix_order (a random key of 0 to 1 for the order of reading).

    budget: tokens to realise as a multiple of all tokens. A document is read whole: the one at which the quota ends is
    read too, so a source exceeds its quota by less than one document. Null sources are one source, null and
    wordless texts have no tokens and are never read, ties of the random order go by doc_id, repeated rows stand at one place and are
    read alike, rows without doc_id are documents of one place too, and an empty table gives an empty one. Columns n_tokens, n_copies and mix_order
    of docs are replaced; all others, whatever their names, stay.
    """
    sources = checkpoint(source_tokens(docs, source))
    quota = checkpoint(_quotas(sources, exponent(sources, budget, target, repeats), budget))
    place = _number(F.lit(seed), F.col("doc_id").cast("string"), digits=12)
    key = docs.select("doc_id", _source(source).alias("_source"), _tokens().alias("_tokens"), place.alias("_r")).filter("_tokens > 0")
    key = key.join(_small(quota), "_source").withColumn("_block", F.col("_r") % F.col("_blocks"))
    # of each block the tokens before it; a row for each block of BLOCK_DOCS documents
    blocks = checkpoint(key.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_sum")))
    blocks = blocks.join(_running(blocks), ["_source", "_block"]).join(quota.select("_source", "_rest"), "_source")
    whole, begun = F.col("_before") + F.col("_sum") <= F.col("_rest"), F.col("_before") < F.col("_rest")
    ends = blocks.groupBy("_source").agg(F.max(F.when(whole, F.col("_block"))).alias("_last"), F.max(F.when(begun & ~whole, F.struct("_block", "_before"))).alias("_edge"))
    quota = _small(checkpoint(quota.join(ends, "_source", "left").select("_source", "_blocks", "_passes", "_rest", "_last", F.col("_edge._block").alias("_edge"), F.col("_edge._before").alias("_before"))))
    # the documents of the block in which the source's quota ends
    edge = key.select("doc_id", "_source", "_tokens", "_r").join(quota, "_source").filter(F.col("_r") % F.col("_blocks") == F.col("_edge"))
    edge = edge.groupBy("_source", "_r", "doc_id", "_before", "_rest").agg(F.sum("_tokens").alias("_tokens"))
    inside = W.partitionBy("_source").orderBy("_r", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).filter(F.col("_at") < F.col("_rest"))
    edge = _small(checkpoint(edge.select(F.col("doc_id").alias("_doc"), F.col("_source").alias("_of"))))

    own = docs.drop("n_tokens", "n_copies", "mix_order")
    own = own.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), _source(source).alias("_source"), _tokens().alias("_tokens"), place.alias("_r"))
    own = own.join(quota, "_source", "left").withColumn("_block", F.col("_r") % F.col("_blocks"))
    own = own.join(edge.withColumn("_more", F.lit(1)), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_source") == F.col("_of")) & (F.col("_block") == F.col("_edge")), "left")
    copies = F.when(F.col("_tokens") > 0, F.col("_passes") + F.when(F.col("_block") <= F.col("_last"), 1).otherwise(F.coalesce("_more", F.lit(0)))).otherwise(0)
    return own.select("_row.*", F.col("_tokens").alias("n_tokens"), copies.cast("long").alias("n_copies"), (F.col("_r") / F.lit(16.0**12)).alias("mix_order"))


#: Blocks of a source whose sums are summed up first, so that no task has more than these or a thousandth of the rest.
RUN = 1024


def _running(blocks: DataFrame) -> DataFrame:
    """_before: the tokens of the source's earlier blocks, summed up in runs of RUN blocks and over the runs."""
    blocks = blocks.withColumn("_run", F.floor(F.col("_block") / RUN))
    runs = blocks.groupBy("_source", "_run").agg(F.sum("_sum").alias("_run_sum"))
    earlier = W.partitionBy("_source").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_run_sum").over(earlier), F.lit(0)))
    within = W.partitionBy("_source", "_run").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.join(runs.select("_source", "_run", "_base"), ["_source", "_run"]).withColumn("_before", F.col("_base") + F.coalesce(F.sum("_sum").over(within), F.lit(0))).select("_source", "_block", "_before")
