import re
from collections import Counter

from pyspark.sql import functions as F

from cargolex.llm import quality_rules as q

TEXTS = [None, "", " \n\t", "a b", "a b c a b c x", "x y z\nx y z\n x y z\n\nq", "é è\x0b# *$ <|>& %\r\nfin fin fin fin", "a " * 60, " ".join(f"w{i}" for i in range(70)), "w1 w2 w3 " + " ".join(f"v{i}" for i in range(60)) + " w1 w2 w3"]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def got(df):
    return {r[0]: tuple(r[1:]) for r in q.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}


def test_counts_as_by_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, rule int")
    assert got(df) == {i: brute(t) for i, t in enumerate(TEXTS)}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(table) == {r.doc_id: brute(r.text) for r in table.collect()}


def test_rules_find_bad_documents_they_have_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    out = q.judge(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    bad, good, caught, lost = out.agg(*(F.count_if(F.expr(x)) for x in ("quality = 0", "quality = 1", "quality = 0 and not kept", "quality = 1 and not kept"))).first()
    assert bad >= 10 and caught >= 0.8 * bad and lost <= 0.02 * good


def test_no_labels_no_rules_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, None), (1, 1)], "doc_id long, quality int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    kept = {r.doc_id for r in q.judge(df, labels).filter("kept").collect()}
    assert kept == {8, 9}
    assert q.judge(df.limit(0), labels.limit(0)).count() == 0
