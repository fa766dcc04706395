import itertools

import numpy as np
from pyspark.sql import functions as F

from cargolex.llm import language_id as lid


def test_forward_backward_as_by_enumeration():
    rnd = np.random.default_rng(1)
    e, t, n, k = rnd.normal(size=(7, 3)), rnd.normal(size=(3, 3)), 7, 3
    chain, place = np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 3, 0, 1, 2])
    p, expected = lid._posteriors(e.astype(np.float32), chain, place, 2, t)
    want, want_t = np.zeros((n, k)), np.zeros((k, k))
    for own in (range(4), range(4, 7)):
        total, at, tr = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=len(own)):
            x = np.exp(sum(e[i, y] for i, y in zip(own, path, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
            total += x
            for i, y in zip(own, path, strict=True):
                at[i, y] += x
            for a, b in itertools.pairwise(path):
                tr[a, b] += x
        want += at / total
        want_t += tr / total
    assert np.allclose(p, want, atol=1e-4) and np.allclose(expected, want_t, atol=1e-3)


def test_words_keep_their_features_in_any_piece():
    one, two = "der und the".encode(), "the und der".encode()
    w = lid._featurised(np.frombuffer(one + two, np.uint8), np.array([0, len(one), len(one) + len(two)]))
    assert w.row.tolist() == [0, 0, 0, 1, 1, 1]
    grams = np.split(w.grams, w.firsts[1:])
    assert all((w.affixes[i] == w.affixes[5 - i]).all() and w.entries[i] == w.entries[5 - i] for i in range(3)) and len(grams) == 6


def test_held_out_accuracy_and_defined_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lid.identify(docs).join(docs.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")), "doc_id")
    n, right, marked, low, high = out.agg(F.count_if("held_out"), F.count_if(F.expr("held_out and lang = lang_pred")), F.count_if(F.expr("held_out = (h % 4 = 2)")), F.min("score"), F.max("score")).first()
    assert right >= 0.97 * n and marked == out.count() and 0 <= low and high <= 1
    again = lid.identify(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang"))))
    assert again.join(lid.identify(docs), ["doc_id", "lang_pred", "score"]).count() == 1000  # labels of held-out rows are never read


def test_nulls_and_letterless_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 … €", "en"), (5, "the thing of the thing", "en"), (6, "der die das und", "de"), (7, "é", None), (8, "the", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(df).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and got[7][0] in ("en", "de") and set(got) == {r[0] for r in rows}
    assert lid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in lid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_overlapping_chains_as_one_long_chain():
    """Words labelled by chains that read into their neighbours are as by one chain of the whole text, exactly where a text fits one."""
    rnd = np.random.default_rng(2)
    sizes = [1, 63, 64, 65, 200, 500, 7]
    row = np.repeat(np.arange(len(sizes)), sizes)
    e = rnd.normal(size=(len(row), 3)).astype(np.float32) * 2
    t = np.eye(3) * 1.5
    words, chain, place, n, core = lid._overlapping(row)
    got = lid._posteriors(e[words], chain, place, n, t, False)[0][core]
    assert (words[core] == np.arange(len(row))).all() and n == sum(-(-s // lid.CHAIN) for s in sizes)
    at = 0
    for s in sizes:
        want, _ = lid._posteriors(e[at : at + s], np.zeros(s, int), np.arange(s), 1, t, False)
        assert np.abs(got[at : at + s] - want).max() < (1e-6 if s <= lid.CHAIN + lid.MARGIN else 1e-3), s
        at += s


def code_switched(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect() if r.lang and r.text and 200 < len(r.text) < 4000]
    return rows


def test_words_of_code_switched_text(spark):
    """Runs of two languages in one text: words bear their run's language, and spans map back to the text."""
    rows = code_switched(spark)
    model = lid.fit(sorted((lang, text) for i, text, lang in rows[: len(rows) // 2]))
    rnd, by = np.random.default_rng(5), {}
    for _, text, lang in rows[len(rows) // 2 :]:
        by.setdefault(lang, []).append([w for w in text.split() if w.isalpha()])
    docs, truth = [], {}
    for i in range(60):
        a, b = rnd.choice(sorted(by), 2, replace=False)
        parts = []
        for j in range(6):
            own = by[(a, b)[j % 2]][rnd.integers(len(by[(a, b)[j % 2]]))]
            at = rnd.integers(max(len(own) - 12, 1))
            parts += [(w, (a, b)[j % 2]) for w in own[at : at + 12]]
        docs.append((i, " ".join(w for w, _ in parts)))
        truth[i] = parts
    df = spark.createDataFrame([*docs, (100, None), (101, "1 2 …")], "doc_id long, text string")
    right = total = 0
    for r in lid.switched(df, model).collect():
        if r.doc_id >= 100:
            assert not r.runs
            continue
        text, got = dict(docs)[r.doc_id], []
        for run in r.runs:
            piece = text[run.start : run.end]
            assert piece == piece.strip() and len(piece.split()) == run.n_words
            got += [run.lang] * run.n_words
        assert len(got) == len(truth[r.doc_id])
        right += sum(x == y for x, (_, y) in zip(got, truth[r.doc_id], strict=True))
        total += len(got)
    assert right >= 0.9 * total, (right, total)


def test_every_language_is_sampled_however_often_texts_repeat(spark):
    rows = [(i, f"the {i} of and", "en") for i in range(300)] + [(1000 + i, "le la les et", "fr") for i in range(3000)] + [(9000 + i, f"der {i} und", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lid.sample(df)
    n = {lang: len([1 for x, _ in got if x == lang]) for lang in ("en", "fr", "de")}
    own = sum(1 for r in df.filter(~lid.held_out(F.col("doc_id")) & (F.col("lang") == "de")).collect())
    assert n == {"en": lid.SAMPLE, "fr": 1, "de": own}
    assert lid.predict(df.limit(5).union(df.limit(5)), lid.fit(got)).count() == 10
    many = spark.range(lid.LANGUAGES * 3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang"))
    assert len({lang for lang, _ in lid.sample(many)}) == lid.LANGUAGES


def test_very_long_text(spark):
    words = "the thing of the other thing and der die das und nicht ".split()
    long = " ".join(words[i % 7 if i < 400_000 else 7 + i % 5] for i in range(600_000))
    df = spark.createDataFrame([(1, "the thing of and", "en"), (2, "der die das und nicht", "de"), (3, "the other thing", "en"), (5, "das und nicht", "de"), (7, long, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(df).collect()}
    assert got[7][0] == "en" and 0.5 < got[7][1] < 0.8


def test_rare_values_of_lang_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(lid, "LANGUAGES", 2)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the thing of the", "en"), ("der die das und", "de")] * 20 + [("zz xx yy", "typo")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lid.identify(df).collect()} == {"en", "de"}
