"""MinHash near-dedup: universal-hash minima, banding, signature verification, exact confirmation, components.

Documents of equal shingle sets form one class first, so a text repeated a thousand times is signed and compared once.
Every other member of a bucket is compared in full with the bucket's center, its likeliest original. After the components of these links are
known, members of different components that have a center in common can only be linked through shingles that the center lacks, or if both lie
almost wholly in it; the pairs for which that is possible, few even in a group of thousands of edited copies, are verified by their
signatures and compared in full. No pair of a bucket that could be linked is left out, and no group is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as v
from .common import checkpoint, texts
from .components import components

SHINGLE = 5
PERCENT = 80
#: A pair at the threshold shares none of 32 bands of 4 minima with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Equal minima, of 128, below which a candidate pair is not compared in full: 5.5 deviations under what a pair at the threshold has.
LEAST_EQUAL = 77

_r = np.random.Generator(np.random.PCG64(97))
_A = _r.integers(1, 1 << 63, BANDS * ROWS, dtype=v.U) * v.U(2) + v.U(1)
_B = _r.integers(0, 1 << 63, BANDS * ROWS, dtype=v.U)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and how many each row has."""
    _, _, row, h = v.words(data, bounds, v.NOT_SPACE)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    keys, of = [], []
    if len(h) >= k:
        at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
        keys.append(v.grams(h, k)[at])
        of.append(row[at])
    for n in range(1, k):
        if len(at := first[counts == n]):
            keys.append(v.mix(v.grams(h, n)[at] + v.U(n)))
            of.append(row[at])
    if not keys:
        return np.zeros(0, v.U), np.zeros(rows, np.int64)
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], np.bincount(of[new], minlength=rows).astype(np.int64)


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text"):
                keys, counts = shingle_sets(data, bounds, len(part), k)
                full = counts > 0
                starts = (np.cumsum(counts) - counts)[full]
                minima = np.zeros((int(full.sum()), len(_A)), np.int32)
                ids = np.zeros((2, len(counts)), v.U)
                if len(keys):
                    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
                        minima[:, i] = np.minimum.reduceat((keys * a + b) >> v.U(32), starts).astype(np.uint32).view(np.int32)
                    ids[0, full] = np.add.reduceat(v.mix(keys), starts)
                    ids[1, full] = np.add.reduceat(v.mix(keys ^ v.U(0x5851F42D4C957F2D)), starts)
                signature = v.lists(minima.ravel(), full * len(_A), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), signature], ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return run


def _compare(k: int, percent: int, extras: bool):
    """Of (u, v, text_u, text_v) the pairs with the sizes of both sets and of their intersection, and whether the full sets are similar enough;
    if asked for, with the shingles that v has and u has not."""

    def run(batches):
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text_v"):
                theirs, n_theirs = shingle_sets(data, bounds, len(part), k)
                ours_id, ours_row = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                first = np.zeros(len(ours_id), np.int64)
                first[ours_row[::-1]] = np.arange(len(part))[::-1]
                ours = part.take(pa.array(first))
                sets = []
                for p, d, b in v.pieces(ours, "text_u"):
                    s, n = shingle_sets(d, b, len(p), k)
                    sets += np.split(s, np.cumsum(n)[:-1])
                n_ours = np.array([len(sets[i]) for i in ours_row], np.int64)
                both, more = np.zeros(len(part), np.int64), []
                for i, theirs_i in enumerate(np.split(theirs, np.cumsum(n_theirs)[:-1])):
                    shared = np.isin(theirs_i, sets[ours_row[i]], assume_unique=True)
                    both[i] = shared.sum()
                    more.append(theirs_i[~shared])
                linked = (both > 0) & (100 * both >= percent * (n_ours + n_theirs - both))
                out = [*part.select(["u", "v"]).columns, pa.array(n_ours), pa.array(n_theirs), pa.array(both), pa.array(linked)]
                names = ["u", "v", "n_u", "n_v", "both", "linked"]
                if extras:
                    out.append(v.lists(np.concatenate(more).view(np.int64), n_theirs - both, pa.int64()))
                    names.append("extras")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


COMPARED = "u long, v long, n_u long, n_v long, both long, linked boolean"
#: Keys with more rows than a hundred-thousandth of all (and than this) are hot: 100,000 at most, so their list can always be broadcast.
LEAST_HOT, MOST_HOT = 1_000, 100_000


def _hot_size(rows: int) -> int:
    return max(LEAST_HOT, -(-rows // MOST_HOT))


def _with_texts(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """pairs(u, v) with text_u and text_v. A u of many pairs is dealt over as many tasks as its pairs fill, each with its own copy of the text."""
    size = _hot_size(pairs.count())
    hot = F.broadcast(pairs.groupBy("u").agg(F.ceil(F.count("*") / size).alias("slices")).filter("slices > 1"))
    pairs = pairs.join(hot, "u", "left").withColumn("slice", F.pmod(F.xxhash64("v"), F.coalesce("slices", F.lit(1)))).drop("slices")
    pairs = pairs.join(whole.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    ours = whole.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")).join(hot, "u", "left")
    ours = ours.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return pairs.join(ours, ["u", "slice"]).select("u", "v", "text_u", "text_v")


def _members(signed: DataFrame) -> DataFrame:
    """doc_id, n_shingles and head: the smallest doc_id of an equal set. Classes of many copies are looked up by broadcast, so none meets in one task."""
    keys = ["n_shingles", "k1", "k2"]
    rows = signed.select("doc_id", *keys)
    classes = checkpoint(rows.filter("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1"))
    hot = F.col("copies") > _hot_size(rows.count())
    large = F.broadcast(classes.filter(hot).drop("copies"))
    small = classes.filter(~hot).drop("copies")
    own = rows.join(large, keys).unionByName(rows.join(large, keys, "left_anti").join(small, keys, "left"))
    return checkpoint(own.select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("head")))


def _still_possible(near: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of two components that were compared with the same center and are not ruled out by what is known from that.

    near: center u, member v, their sizes, `both` (a member's shingles in the center's set) and `extras` (the others). Two members x and y
    are linked only if they share need = percent / (100 + percent) * (n_x + n_y) shingles, of which at most min(both_x, both_y) lie in
    the center's set. So either this alone is enough, or they share need - min(both_x, both_y) extras, and meet at one of them. Both cases are exact.
    """
    of = found.withColumnRenamed("node", "v").withColumnRenamed("component", "c")
    centers = found.withColumnRenamed("node", "u").withColumnRenamed("component", "c_u")
    group = near.join(of, "v", "left").join(centers, "u", "left")
    group = group.select(F.col("u").alias("hub"), F.col("v").alias("doc"), F.coalesce("c", "v").alias("c"), F.coalesce("c_u", "u").alias("main"), F.col("n_v").alias("n"), F.col("both").alias("a"), "extras")
    mixed = group.groupBy("hub").agg(F.min("c").alias("c_least"), F.max("c").alias("c_most"), F.min("n").alias("least")).filter("c_least < c_most").select("hub", "least")
    group = checkpoint(group.join(mixed, "hub"))
    need = lambda n, m: F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)
    sizes = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    ren = lambda df, *keep: df.select(*keep, *(F.col(k).alias(f"{k}_x") for k in ("doc", "c", "n", "a", *(("s",) if "s" in df.columns else ()))))
    # members of the center's own component meet the others alone; of two others the smaller id comes first
    once = (F.col("c") != F.col("c_x")) & ((F.col("c") == F.col("main")) | (F.col("doc_x") < F.col("doc"))) & sizes(F.col("n"), F.col("n_x"))

    shared = group.select("hub", "doc", "c", F.explode("extras").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("df"), F.min("c").alias("c_least"), F.max("c").alias("c_most")).filter("c_least < c_most").select("hub", "e", "df")
    own = group.select("hub", "doc", "c", "main", "n", "a", F.explode("extras").alias("e")).join(shared, ["hub", "e"])
    # of s such extras that a member has, and k that a pair needs, one at least is among the member's s - k + 1 rarest
    by = W.partitionBy("hub", "doc")
    least = F.greatest(F.ceil(F.col("n") * percent / 100.0 - 1e-9) - F.col("a"), F.lit(1))
    own = own.withColumn("s", F.count("*").over(by)).withColumn("at", F.row_number().over(by.orderBy("df", "e")))
    own = checkpoint(own.filter(F.col("at") <= F.col("s") - least + 1).drop("df", "at"))
    enough = F.least("s", "s_x") >= need(F.col("n"), F.col("n_x")) - F.least("a", "a_x")
    meet = ren(own.filter("c != main"), "hub", "e").join(own, ["hub", "e"]).filter(once & enough).select("doc_x", "doc")

    within = lambda n, m, a: F.col(a) >= need(F.col(n), m)
    slim = group.drop("extras")
    few = slim.filter((F.col("c") != F.col("main")) & within("n", F.greatest(F.col("least"), F.col("n") * percent / 100.0), "a"))
    # what partners of these can be: no larger than their intersection with the center allows
    most = few.groupBy("hub").agg(F.max(F.floor(F.col("a") * (100.0 + percent) / percent + 1e-9) - F.col("n")).alias("most"), F.min("n").alias("n_few"))
    others = slim.join(most, "hub").filter((F.col("n") <= F.col("most")) & within("n", F.greatest(F.col("n_few"), F.col("n") * percent / 100.0), "a"))
    others = others.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    few = few.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(SLICES)).cast("int"))
    inside = ren(few, "hub", "slice").join(others, ["hub", "slice"]).filter(once & (F.least("a", "a_x") >= need(F.col("n"), F.col("n_x")))).select("doc_x", "doc")
    return meet.union(inside).select(F.least("doc_x", "doc").alias("u"), F.greatest("doc_x", "doc").alias("v")).distinct()


#: Slices that the pairs of one center without shared extras are dealt over.
SLICES = 8


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of word shingles. Null, empty and wordless texts
    have an empty set and stand alone; fewer words than a shingle are one shingle; repeated rows are copies, which get the same result; of rows
    with one doc_id and different texts one stands for the id; a row without doc_id counts only as a copy of a set that others have (component_id is
    NULL and it is kept if there are none); an empty table gives an empty one; other columns are not looked at.
    """
    signed = checkpoint(texts(docs).mapInArrow(_sign(shingle), "doc_id long, n_shingles long, k1 long, k2 long, signature array<int>"))
    member = _members(signed)
    heads = member.filter((F.col("doc_id") == F.col("head")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    heads = checkpoint(signed.select("doc_id", "signature").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.slice("signature", i * ROWS + 1, ROWS), i))
    banded = heads.select("doc_id", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = checkpoint(banded.join(shared, "band"))
    # the member that shares most buckets with most others is the likeliest original of a group of edited copies
    degrees = checkpoint(buckets.groupBy("doc_id").agg(F.sum("size").alias("degree")))
    whole = checkpoint(texts(docs).join(degrees, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    centers = buckets.join(degrees, "doc_id").groupBy("band").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("id"))).alias("center"))
    near = buckets.join(centers, "band").select((-F.col("center")["id"]).alias("u"), F.col("doc_id").alias("v")).filter("u != v").distinct()
    near = checkpoint(_with_texts(checkpoint(near), whole).mapInArrow(_compare(shingle, percent, True), f"{COMPARED}, extras array<long>"))
    links = near.filter("linked").select("u", "v")

    rest = checkpoint(_still_possible(near, components(links), percent))
    sign = lambda x: heads.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s_{x}"))
    equal = F.aggregate(F.zip_with("s_u", "s_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)
    rest = checkpoint(rest.join(sign("u"), "u").join(sign("v"), "v").filter(equal >= LEAST_EQUAL).select("u", "v"))
    more = checkpoint(_with_texts(rest, whole).mapInArrow(_compare(shingle, percent, False), COMPARED))
    found = components(links.union(more.filter("linked").select("u", "v"))).withColumnRenamed("node", "head")
    out = member.join(found, "head", "left").select("doc_id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
