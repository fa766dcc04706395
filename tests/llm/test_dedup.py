"""Near-dedup and suffix dedup against brute force, on a table of the driver and on planted cases."""

import hashlib
import random
import re

import pytest

from cargolex.llm import minhash, suffix_dedup
from cargolex.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, center string, m long"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0, "x", 1) for i, t in texts.items()], DOCS)


def planted():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    base = [word() for _ in range(120)]
    out = {10: " ".join(base), 11: " ".join(base).upper(), 12: " ".join(base[:60] + ["x"] + base[61:]), 13: None, 14: "", 15: " \t\n", 16: "one two", 17: "One  two", 18: "one two three"}
    for i in range(20, 60):
        own = list(base)
        for _ in range(rnd.randint(1, 6)):
            own[rnd.randrange(120)] = word()
        out[i] = " ".join(own)
    for i in range(60, 90):
        out[i] = " ".join(word() for _ in range(50)) + (" " + " ".join(base[:30]) if i % 2 else "")
    out[90], out[91], out[92] = "a" * 350, "a" * 120 + "b" + "a" * 100, "ab" * 4000
    out[93] = "é" * 80 + " " + " ".join(base[40:80])
    return out


def brute_components(texts, k=4):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 80 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if (s := b[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.fixture(scope="module", params=["planted", "table", "none"])
def docs(request, spark):
    if request.param == "table":
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}, df
    texts = planted() if request.param == "planted" else {}
    return texts, rows_of(spark, texts)


def test_near_duplicates_as_by_brute_force(docs):
    texts, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(texts)


def test_repeats_as_by_brute_force(docs):
    texts, df = docs
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(df.repartition(3)).collect()}
    assert got == brute_repeats(texts)


def test_sorted_runs_settle_over_batches():
    import pyarrow as pa

    def batches(rows, size):
        t = pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("m", "c", "doc_id", "at", "n"))})
        return t.to_batches(max_chunksize=size)

    rows = [(1, 1, 0, 0, 1), (1, 1, 3, 0, 1), (2, 1, 0, 0, 1), (2, 1, 1, 0, 1), (2, 2, 1, 5, 1), (3, 1, 0, 0, 1), (4, 1, 0, 0, 1), (4, 1, 9, 0, 1), (5, 1, 0, 0, 1), (5, 1, 1, 0, 1)]
    want = [(1, 1, 0, 2), (1, 1, 3, 0), (2, 1, 0, 1), (2, 1, 1, 0), (2, 2, 1, 1), (4, 1, 9, 0), (5, 1, 0, 2), (5, 1, 1, 0)]
    for size in (1, 2, 3, 4, 7, 10):
        got = [r for b in suffix_dedup._neighbours(batches(rows, size)) for r in b.to_pylist()]
        assert sorted((r["m"], r["c"], r["doc_id"], r["kind"]) for r in got) == want, size
    for n in range(1, 4):
        got = [r["kind"] for b in suffix_dedup._neighbours(batches([(1, 1, i, 0, 1) for i in range(n)], 1)) for r in b.to_pylist()]
        assert got == [2] + [0] * (n - 1)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
