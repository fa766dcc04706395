"""Ranked search, spelling variants and exact dedup against brute force, and on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cargolex.llm import exact_dedup, ranked_search, spelling

DOCS = "doc_id long, text string, lang string, item long, n long, sha string, row long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 5, 7, "x", 1) for i, t in rows], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ranked search


def brute_search(docs, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(lowered(w) for w in word.findall(t or ""))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(lowered(w) for w in word.findall(text or ""))
        scores = []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_all
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_docs(rnd, n, many):
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "Straße", "Tab́"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 80)))) for i in range(n)]
    return rows + [(n + i, "Copy of w7, w9; w11!") for i in range(many)] + [(None, "copy of w7 w9 w11"), (n + many, None), (n + many + 1, " \t.,"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_search_as_by_brute_force(spark, monkeypatch, shard):
    rnd = random.Random(8)
    docs = some_docs(rnd, 600, 200)
    items = [(i, " ".join(rnd.choices([f"w{j}" for j in range(300)], k=rnd.randint(1, 12)))) for i in range(30)]
    items += [(90, "w7 W9 w11 w7 copy"), (91, None), (92, "..."), (93, "unknown"), (94, "été straße w5"), (94, "w1")]
    own = spark.createDataFrame([(i, t, 9, "b") for i, t in items], "item_id long, text string, doc_id long, term string")
    got = ranked_search.search(rows_of(spark, docs), own).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(docs, items)
    # the shards of a task, however small, give the same
    asked = (np.array([1, 1, 2]), np.array([10, 20, 20]), np.array([1, 2, 1]), np.array([500, 300, 300]))
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    n = [rnd.randint(1, 9) for _ in range(400)]
    tf = [[rnd.randint(1, 3), rnd.randint(1, 3)] for _ in n]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(n, pa.int64()), pa.array([[10, 20]] * 400), pa.array(tf)], ["doc_id", "n", "terms", "tfs"])
    sent = type("Sent", (), {"value": asked})
    parts = [batch.slice(i, 37) for i in range(0, 400, 37)]
    (top,) = list(ranked_search._search(sent, (400, sum(n)), 5)(iter(parts)))
    found = list(zip(*(top.column(i).to_pylist() for i in range(3)), strict=True))

    def impact(i, which, weight):
        return weight * (1000000000 * tf[i][which] // (1000 * tf[i][which] + 8 * (25 + 75 * n[i] * 400 // sum(n))))

    want = [(1, i, -s) for s, i in sorted((-(impact(i, 0, 500) + 2 * impact(i, 1, 300)), i) for i in range(400))[:5]]
    assert found == want + [(2, i, -s) for s, i in sorted((-impact(i, 1, 300), i) for i in range(400))[:5]]


def test_search_stops_only_strictly_below_the_kth_score():
    """Equal scores far down a list still count, as a smaller doc_id wins there."""
    n = 5000
    docs, terms = np.arange(n), np.zeros(n, np.int64)
    shard = ranked_search.Shard(np.arange(n)[::-1].copy(), docs, terms, np.full(n, 7, np.int64), 1)
    none = np.zeros(0, np.int64)
    scores, ids = shard.best(np.array([0]), np.array([1]), 3, none, none)
    assert scores.tolist() == [7, 7, 7] and ids.tolist() == [0, 1, 2]


def test_search_reads_only_the_tops_of_its_lists():
    rnd = np.random.default_rng(1)
    n = 20000
    impact = np.r_[rnd.integers(900, 1000, 40), rnd.integers(1, 100, n - 40)]
    shard = ranked_search.Shard(np.arange(n), np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.r_[impact, impact], 2)
    looked = []
    shard.look_up = lambda docs, *a, own=shard.look_up: looked.append(len(docs)) or own(docs, *a)
    none = np.zeros(0, np.int64)
    scores, _ = shard.best(np.array([0, 1]), np.array([1, 1]), 10, none, none)
    assert scores.tolist() == sorted((2 * impact).tolist(), reverse=True)[:10] and sum(looked) < 400


def test_search_of_empty_tables_and_long_texts(spark):
    none = rows_of(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for found in (ranked_search.search(none, items), ranked_search.search(rows_of(spark, [(1, "a b")]), items.filter("false")), ranked_search.search(rows_of(spark, [(1, None)]), items)):
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    long = " ".join(f"w{i % 90000}" for i in range(400_000)) + " needle"
    docs = [(1, long), (2, "needle and hay"), (3, "hay")]
    got = ranked_search.search(rows_of(spark, docs), spark.createDataFrame([(5, "needle w7")], "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(docs, [(5, "needle w7")])


# spelling variants


def brute_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    alphabet = {c for w in n for c in w}
    near = {}
    for w in n:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        near[w] = [u for u in made - {w} if u in n]
    form = {w: min(near[w], key=lambda u: (-n[u], u)) if near[w] else None for w in n}
    form = {w: u if u and n[u] >= 10 * n[w] else None for w, u in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def variants_of(spark, docs):
    return sorted((tuple(r) for r in spelling.group_variants(rows_of(spark, docs)).collect()), key=str)


def corpus(rnd):
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(6, 11))) for _ in range(60)] + ["Überraschung", "aaaaaaaa", "aaaaaaaaa", "x" * 90, "x" * 91, "Ÿÿÿñññß"]
    weights = [2 ** -(i % 12) for i in range(len(words))]
    out = []
    for i in range(400):
        own = rnd.choices(words, weights, k=40)
        for _ in range(3):
            at = rnd.randrange(40)
            w = own[at]
            j = rnd.randrange(len(w))
            own[at] = rnd.choice((w[:j] + w[j + 1 :], w[:j] + "z" + w[j:], w[:j] + "q" + w[j + 1 :]))
        out.append((i, rnd.choice((" ", ", ", "1", "Ā")).join(own)))
    out += [(1000 + i, w) for i, w in enumerate(["chainabcd"] * 300 + ["chainabce"] * 24 + ["chainabcef"] * 2)]
    return out + [(None, "aaaaaaaa aaaaaaaa bbbbbbbb"), (500, None), (501, ""), (3, out[3][1]), (3, out[3][1])]


@pytest.mark.parametrize("shard", [5, 200_000])
def test_variants_as_by_brute_force(spark, monkeypatch, shard):
    """With the small shard nearly every key is hot and dealt to a square of shards."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    docs = corpus(random.Random(4))
    got, want = variants_of(spark, docs), brute_variants(docs)
    assert got == want and sum(x[1] is not None for x in want) > 50 and any(x[1] != x[2] for x in want if x[1])


def test_roots_follow_forms_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling.roots(chain, 11).collect()} == {"w11"}


def test_variants_of_empty_tables_and_long_texts(spark):
    assert variants_of(spark, []) == [] and variants_of(spark, [(1, None), (2, "short words")]) == []
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=9)) for _ in range(500)]
    docs = [(1, " ".join(rnd.choices(words, k=200_000)))]
    long = [(i, "y" * 300_000) for i in (2, 4, 5)]
    cut = [zlib.crc32(f"{i}:{t}".encode()) % 31 == 0 for i, t in long]
    assert not any(cut)
    assert variants_of(spark, docs + long) == sorted([*brute_variants(docs), ("y" * 300_000, None, "y" * 300_000, 3, 0, None)], key=str)


# exact dedup


def brute_equal(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def copies(rnd):
    rows = [(i, f"text {rnd.randrange(300)}") for i in range(400)] + [(1000 + i, "HOT copy Ä") for i in range(300)]
    rows += [(2000, "hot COPY Ä"), (2001, "hot copy ä"), (2002, None), (2003, ""), (2004, " "), (None, "hot copy Ä"), (None, "alone"), (None, "alone"), (2005, "same row"), (2005, "same row"), (2006, "z" * 3_000_000), (2007, "Z" * 3_000_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1 << 15, 1 << 30])
def test_equal_texts_as_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", most)
    rows = copies(random.Random(6))
    got = sorted((tuple(r) for r in exact_dedup.equal_texts(rows_of(spark, rows).repartition(6)).collect()), key=str)
    assert got == brute_equal(rows)


def test_whole_rows_that_stay(spark):
    rows = copies(random.Random(7))
    left = exact_dedup.deduplicate(rows_of(spark, rows).repartition(5))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = left.collect()
    kept = [(lowered(r.text), r.doc_id) for r in got]
    assert len(kept) == len({t for t, _ in kept}) and {t for t, _ in kept} == {lowered(t) for _, t in rows}
    best = {}
    for i, t in rows:
        best[lowered(t)] = max(best.get(lowered(t), -1), -1 if i is None else i)
    assert all(best[t] == (-1 if i is None else i) for t, i in kept) and {r.sha for r in got} == {"x"}
    assert exact_dedup.deduplicate(rows_of(spark, [])).collect() == [] and exact_dedup.equal_texts(rows_of(spark, [])).collect() == []


def test_only_rows_that_may_be_repeated_are_shuffled(spark):
    """Of ten thousand different texts and two copies the filter lets few through, and both copies."""
    rows = rows_of(spark, [(i, f"text number {i}") for i in range(10_000)] + [(20_000, "text number 5")])
    own = rows.select("doc_id", exact_dedup.fingerprint(rows.text).alias("sha"))
    slots = exact_dedup.slots_for(10_001)
    flagged = exact_dedup.maybe_repeated(own, exact_dedup.set_again(own, slots), slots).filter("_maybe")
    ids = {r.doc_id for r in flagged.collect()}
    assert {5, 20_000} <= ids and len(ids) < 500
    plan = exact_dedup.maybe_repeated(own, exact_dedup.set_again(own, slots), slots)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
