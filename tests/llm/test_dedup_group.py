"""A group of hundreds of edited copies around the threshold, and odd tables, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cargolex.llm import minhash
from cargolex.llm import vectors as v

from .test_dedup import brute_components, rows_of


def edited_copies(seed, sizes_vary):
    """Copies of one text with unique and repeated edits: many just above, many just below the threshold, some linked only through others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(9999)}" for _ in range(130)]
    few = [f"e{i}" for i in range(6)]
    out = {}
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randint(2, 8)):
            at = rnd.randrange(len(own))
            own[at] = rnd.choice(few) if rnd.random() < 0.5 else f"u{i}x{at}"
            if rnd.random() < 0.3:
                own[(at + 1) % len(own)] = rnd.choice(few)
        if sizes_vary:
            cut = rnd.choice((0, 0, rnd.randint(0, 45)))
            own = own[: len(own) - cut] if rnd.random() < 0.5 else own[cut:]
            own += [f"t{i}y{j}" for j in range(rnd.choice((0, 0, rnd.randint(0, 30))))]
        out[1000 - i] = " ".join(own)
    # a second template inside the group, near itself and not near the first
    other = base[:70] + [f"z{rnd.randrange(9999)}" for _ in range(60)]
    for i in range(60):
        own = list(other)
        for _ in range(rnd.randint(1, 6)):
            own[rnd.randrange(len(own))] = rnd.choice(few + [f"v{i}"])
        out[2000 + i] = " ".join(own)
    return out


@pytest.mark.parametrize(("seed", "sizes_vary"), [(1, False), (2, True), (3, True)])
def test_group_around_the_threshold_as_by_brute_force(spark, seed, sizes_vary):
    texts = edited_copies(seed, sizes_vary)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows_of(spark, texts), 4).collect()}
    want = brute_components(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 340


def test_pairs_left_over_are_few_and_whole(spark):
    """Of pairs in one group none that is linked is ruled out, though most of the pairs that are not linked are."""
    texts = edited_copies(4, True)
    ids = sorted(texts)
    keys, n = minhash.shingle_sets(*_bytes([texts[i] for i in ids]), len(ids), 4)
    sets = dict(zip(ids, map(set, np.split(keys, np.cumsum(n)[:-1])), strict=True))
    hub = ids[0]
    rows = [(hub, i, len(sets[hub]), len(sets[i]), len(sets[hub] & sets[i]), [int(x) - (1 << 64) * (x >> 63 == 1) for x in map(int, sets[i] - sets[hub])]) for i in ids[1:]]
    near = spark.createDataFrame(rows, "u long, v long, n_u long, n_v long, both long, extras array<long>")
    alone = spark.createDataFrame([], "node long, component long")
    got = {(r.u, r.v) for r in minhash._still_possible(near, alone, 80).collect()}
    linked = {(a, b) for a in ids[1:] for b in ids[1:] if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked <= got and len(got) < 0.75 * len(ids) ** 2 / 2


def _bytes(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    (_, data, bounds), *more = v.pieces(batch, "text", 1 << 30)
    assert not more
    return data, bounds


def test_pairs_at_the_threshold_share_a_band_and_pass_the_signature():
    """Measured, not computed: pairs whose similarity is exactly 0.8 (180 of 225 shingles in common)."""
    rnd, met, passed, pairs = np.random.default_rng(7), 0, 0, 2000
    for _ in range(pairs):
        keys = rnd.integers(0, 1 << 63, 225, dtype=np.uint64)
        signed = [np.array([((own * a + b) >> np.uint64(32)).min() for a, b in zip(minhash._A, minhash._B, strict=True)]) for own in (keys[:202], np.concatenate([keys[:180], keys[202:]]))]
        equal = signed[0] == signed[1]
        met += equal.reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any()
        passed += equal.sum() >= minhash.LEAST_EQUAL
    assert met == passed == pairs


def test_repeated_rows_null_ids_and_long_texts(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(50000)}" for _ in range(250_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A  B c\td e"), (None, "a b c d e"), (None, "x y z u v"), (None, None), (3, long), (4, long + " end"), (5, None), (5, None)]
    df = spark.createDataFrame([(i, t, 0.5, "c", [1]) for i, t in rows], "doc_id long, text string, component_id double, head string, signature array<int>")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (None, None, True), (3, 3, True), (4, 3, False), (5, 5, True), (5, 5, True)]
    assert got == sorted(want, key=str)
