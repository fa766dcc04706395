"""Single scans, gates and folds: the same as the plain way, and no slower for one long text than for many short ones."""

import random
import re
import time

from pyspark.sql import functions as F

from cargolex.functions import fuzzy, rx, textnorm
from cargolex.operators import layout, rows, sections
from cargolex.plans import forms


def one(df):
    return df.first()[0]


def test_fuzzy_roles_as_in_python(spark):
    rnd = random.Random(3)
    names = [n for _, own in fuzzy.TITLES for n in own]
    titles = ["", "   ", "a", "Наименование"]
    for _ in range(300):
        t = list(rnd.choice(names) + rnd.choice(["", " ООО «Ромашка» и ещё очень длинный хвост"]))
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice(["", rnd.choice("абвгдъ xЁ"), t[i] * 2])
            t = t or ["а"]
        titles.append(rnd.choice(["", "  ", "\xa0"]) + "".join(t)[rnd.choice([0, 0, 3]) :].capitalize() + rnd.choice(["", " ", ":", "\n"]))
    df = spark.createDataFrame([(titles,)], "titles array<string>")
    got = one(df.select(fuzzy.fuzzy_roles("titles")))
    assert got == [fuzzy.fuzzy_role(t) for t in titles] and 100 < sum(x is not None for x in got) < 280


def test_parsing_runs_no_python(spark):
    files = forms.rendered(spark, "/root/testdata/sf0.001").select(F.col("o_orderkey").cast("string").alias("source"), "text")
    plan = rows.parse(files, forms.AS_OF_YEAR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_headings_of_a_very_long_text(spark):
    """20,000 headings: every one is placed where it stands, in a time that grows with the text."""
    took = {}
    for n in (5_000, 20_000):
        text = "начало\n" + "\n".join(f"{i % 20 + 1}. {('Груз', 'Отметки', 'Перевозчик', 'Раздел')[i % 4]}\nтекст {i}" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.time()
        got = one(df.select(sections.header_candidates(F.col("text"))))
        s = sections.add_sections(df).select("sections.*").first()
        took[n] = time.time() - began
        assert len(got) == n and all(text[c.pos : c.pos + 4].strip()[0].isdigit() for c in got) and [c.pos for c in got] == [m.start() for m in re.finditer(r"^\d+\. ", text, re.M)]
        assert s.head == "начало" and s.cargo == "текст 0" and s.carrier.startswith("текст 2") and s.shipper is None
    assert took[20_000] < 8 * took[5_000] + 5


def test_matches_of_a_long_text_are_placed(spark):
    text = "".join(f"{i} слово " for i in range(3000))
    got = one(spark.createDataFrame([(text,)], "t string").select(rx.matches(F.col("t"), "[0-9]+")))
    assert [(m.at, m.found) for m in got] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", text)]
    first = spark.createDataFrame([("ab12cd34",), ("none",), (None,)], "t string").select(rx.first_match(F.col("t"), "[0-9]|x(y)")).collect()
    assert [r[0] and (r[0].at, r[0].found) for r in first] == [(2, "1"), None, None]


def test_a_page_of_thousands_of_spans(spark):
    rnd = random.Random(1)
    spans = [(40.0 + 300 * (i % 2), 12.0 * (i // 2) + rnd.choice((0.0, 2.0)), 140.0 + 300 * (i % 2), 12.0 * (i // 2) + 9, f"{'лп'[i % 2]}{i // 2}") for i in range(5_000)]
    rnd.shuffle(spans)
    df = spark.createDataFrame([(spans,)], "spans array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    began = time.time()
    text = one(df.select(layout.render(F.col("spans"), F.lit(480.0))))
    assert text == "\n".join(f"л{i}" for i in range(2500)) + "\n\n" + "\n".join(f"п{i}" for i in range(2500)) and time.time() - began < 60


def test_gates_let_no_garbage_through(spark):
    """Lines that the one scan calls clean have no garbage token, and what is kept of a line does not depend on it."""
    rnd = random.Random(9)
    tokens = ["слово", "word", "сlово", "сlоwо", "12.05", "№", "!?", "..", "-", "'а", "а\"б", "5'", "«ООО»", "і", "Ünal", "—", "|", "a-б", "а1b", "\x1c", "٣"]
    lines = [" ".join(rnd.choices(tokens, k=rnd.randint(0, 6))) for _ in range(400)] + ["", " ", "\xa0 \x85", "  а  б "]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    out = df.select("x", textnorm.may_have_garbage(F.col("x")).alias("may"), F.exists(textnorm.tokens(F.col("x")), textnorm.is_garbage_token).alias("any"), textnorm.noise_share(F.col("x")).alias("share"), F.size(textnorm.tokens(F.col("x"))).alias("n"), F.size(F.filter(textnorm.tokens(F.col("x")), textnorm.is_garbage_token)).alias("bad")).collect()
    assert all(r.may or not r.any for r in out) and all(r.share == (r.bad / r.n if r.n else 1.0) for r in out) and sum(not r.may for r in out) > 20


def test_edges_are_cut_as_by_a_regular_expression(spark):
    classes = [r"\s", r"\s.,:;", r" \t|—–\-\[\]()", textnorm.AROUND, r" ,;:\-–—"]
    texts = ["  a b  ", "\xa0—x— ", "[(a)]", "...", "", "‐―‘x’“", "\ta\n"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for own in classes:
        plain = rf"(?U)^[{own}\x1c-\x1f]+|[{own}\x1c-\x1f]+\z" if r"\s" in own else rf"^[{own}]+|[{own}]+\z"
        assert all(r.a == r.b for r in df.select(rx.strip(F.col("x"), own).alias("a"), F.regexp_replace("x", plain, "").alias("b")).collect()), own
