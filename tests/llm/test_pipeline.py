"""Each stage against brute force on its own input, and the operators' tables of nulls, ties and repeats."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolex.llm import decontamination, line_dedup, mixing, suffix_dedup

from .test_dedup import brute_components

SF = "/root/testdata/sf0.001"
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words9(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words9(t)
        for k in range(max(len(w) - 9, 1)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs.items():
        w, hit, found = words9(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[own]
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


def brute_lines(docs):
    pages, counts = Counter(s for s, _ in docs.values()), Counter()
    core = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for s, t in docs.values():
        counts.update({(s, core(x)) for x in (t or "").split("\n") if core(x)})
    bad = lambda s, x: core(x) and counts[s, core(x)] >= line_dedup.MIN_PAGES and counts[s, core(x)] > pages[s] * line_dedup.MAX_RATIO
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if not bad(s, x)) for d, (s, t) in docs.items()}


def brute_mix(docs):
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, (_, t) in docs.items()}
    total, n = Counter(), Counter()
    for d, (s, _) in docs.items():
        total[s] += tokens[d]
        n[s] += 1
    everything = sum(total.values())
    p = {s: x / everything for s, x in total.items() if x}

    def at(k):
        w = {s: x ** (k / 1024) for s, x in p.items()}
        z = sum(w.values())
        if len(p) < 2:
            return 1.0, 0.0
        return -sum(x / z * math.log(x / z) for x in w.values()) / math.log(len(p)), max(w[s] / z / p[s] for s in p)

    k = max([k for k in range(1025) if at(k)[0] >= mixing.TARGET_ENTROPY], default=0)
    k = min([j for j in range(k, 1025) if at(j)[1] <= mixing.MAX_REPEATS], default=1024)
    w = {s: x ** (k / 1024) for s, x in p.items()}
    out = {}
    for s in total:
        quota = math.floor(everything * w.get(s, 0) / sum(w.values())) if p else 0
        blocks = -(-n[s] // mixing.BLOCK_DOCS)
        r = {d: int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:12], 16) for d, (x, _) in docs.items() if x == s}
        at_ = 0
        for d in sorted(r, key=lambda d: (r[d] % blocks, r[d], d)):
            out[d] = (quota // total[s] + (at_ < quota % total[s])) if tokens[d] else 0
            at_ += tokens[d]
    return out


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def taken(df):
    return {r.doc_id: (r.source, r.text) for r in df.collect()}


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert before.dtypes == after.dtypes


def test_language_keeps_all_with_letters(steps):
    before, after = map(taken, steps[0])
    assert after.items() <= before.items() and len(after) >= 0.97 * len(before)


def test_lines(steps):
    before, after = map(taken, steps[1])
    assert {d: t for d, (_, t) in after.items()} == brute_lines(before) and before != after


def test_near_duplicates(steps):
    before, after = map(taken, steps[2])
    comp = brute_components({d: t for d, (_, t) in before.items()}, 5)
    assert after == {d: x for d, x in before.items() if comp[d][1] == d} and len(after) < len(before)


def test_benchmark(spark, steps):
    before, after = map(taken, steps[3])
    hits = brute_hits({d: t for d, (_, t) in before.items()}, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert after == {d: x for d, x in before.items() if not hits[d][1]}


def test_mixture(steps):
    before, after = steps[4]
    want = brute_mix(taken(before))
    assert {r.doc_id: r.n_copies for r in after.collect()} == {d: n for d, n in want.items() if n}


def test_run_is_the_stages(spark, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in steps[4][1].collect())


def test_short_items_ties_and_nulls(spark):
    items = [(1, "one two three"), (2, "x"), (3, None), (4, " ,"), (5, " ".join(f"w{i}" for i in range(14))), (5, "One two THREE"), (6, "a b a b a b a b a b a b a b"), (7, "é ß 9 q w e r t y u i")]
    docs = {1: None, 2: "", 3: "x", 4: "zero one, two. three four x x", 5: " ".join(f"w{i}" for i in range(3, 14)), 6: "b a " * 30, 7: "é-ß!9 Q w e r t y u", 8: " ".join(f"w{i}" for i in range(9)), 9: "one two"}
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    df = spark.createDataFrame([(d, t, 3, 4) for d, t in docs.items()], "doc_id long, text string, item_id long, n_hit int")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(map(str, r.item_ids or []))) for r in decontamination.contamination(df, bench).collect()}
    assert got == brute_hits(docs, items)
    assert {r.n_hit for r in decontamination.contamination(df, bench.limit(0)).collect()} == {0}
    assert decontamination.contamination(df.limit(0), bench).count() == 0


def test_lines_and_mix_of_odd_tables(spark):
    rows = {i: ("s" if i % 3 else None, t) for i, t in enumerate([None, "", "a\n\n a \nb", "a", "a\r\nc", "a\nc\n", "d"] * 4)}
    df = spark.createDataFrame([(d, t, s, 1.5, "x") for d, (s, t) in rows.items()], "doc_id long, text string, source string, n_copies double, _x string")
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()} == brute_lines(rows)
    clash = df.selectExpr("*", "'h' as _host", "array(1L) as _set", "'k' as _kept", "struct(1 as a) as _row", "7 as n_lines", "'t' as _text")
    for make in (line_dedup.drop_boilerplate, mixing.mix):
        out = make(clash)
        assert {(r._host, tuple(r._set), r._kept, r._row.a, r._text, r._x) for r in out.collect()} == {("h", (1,), "k", 1, "t", "x")}
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(clash).collect()} == brute_lines(rows)
    named = {d: (s or "", t) for d, (s, t) in rows.items()}
    assert {r.doc_id: r.n_copies for r in mixing.mix(df).collect()} == brute_mix(named)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert {r.n_copies for r in mixing.mix(df.withColumn("text", F.lit(" "))).collect()} == {0}


def test_empty_and_unlabelled_runs(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("none", []), ("nulls", [(i, None, None, None, None) for i in range(3)]), ("unlabelled", [(1, "the thing of the other", None, "a", 22)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).count() == 0, name


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, "x " + long, "a"), (None, long, "a"), (3, "short", "b"), (3, "another text", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.cut_repeats(df).collect()), key=str)
    assert out == sorted([(1, 0), (1, 0), (2, len(long)), (None, 0), (3, 0), (3, 0)], key=str)
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(12)))], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit) for r in decontamination.contamination(df, bench).collect()]
    assert got.count((1, 60, 12)) == 2 and (2, 61, 12) in got and len(got) == 6
    read = mixing.mix(df).collect()
    assert len(read) == 6 and len({r.n_copies for r in read if r.doc_id == 1}) == 1


def test_very_long_texts(spark):
    """One text of some megabytes among short ones, in every operator of the pipeline that had none."""
    body = "\n".join(f"line {i} of many words to read on and on" for i in range(12_000))
    item = "a question that stands in the benchmark and nowhere else at all"
    rows = [(1, body + " " + item, "a"), (2, "short text", "a"), (3, body[:-1], "a"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    lines = {r.doc_id: r.n_lines for r in line_dedup.drop_boilerplate(df).collect()}
    assert lines == {1: 12_000, 2: 1, 3: 12_000, 4: 0}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontamination.contamination(df, bench).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.cut_repeats(df).collect()} == {i: x[0] for i, x in removed({i: t for i, t, _ in rows}).items()}
    assert {r.doc_id: r.n_tokens for r in mixing.mix(df).collect()} == {i: len((t or "").split()) for i, t, _ in rows}


def removed(texts):
    from .test_dedup import brute_repeats

    return {i: (x[1],) for i, x in brute_repeats(texts).items()}


def test_a_sentence_of_many_items_and_documents(spark):
    """400 items and 500 documents that share a sentence: a row for each place in a document, and each row of docs has its own result."""
    shared = " ".join(f"s{i}" for i in range(12))
    items = [(i, f"own{i} " * 3 + shared + f" end{i}") for i in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"doc {i} {shared} tail {i}") for i in range(500)] + [(None, shared), (7, "clean text"), (None, "clean too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, hits, lists = decontamination.matched_windows(df, bench)
    assert hits.count() < 10_000 and lists.count() < 10_000
    got = decontamination.contamination(df, bench).collect()
    assert sorted((str(r.doc_id), r.n_hit, len(r.item_ids or [])) for r in got) == sorted([*((str(i), 12, 400) for i in range(500)), ("None", 12, 400), ("7", 0, 0), ("None", 0, 0)])
