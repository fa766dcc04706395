"""What a step costs a row, read off its plan; and that what is left out changes no result."""

import random

from pyspark.sql import functions as F

from cargolex.functions import fuzzy, rx, textnorm
from cargolex.operators import sections
from cargolex.plans import catalog, forms

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forms_are_dealt_as_keys_to_tasks_that_stay_as_long(spark, monkeypatch):
    own = forms.values(spark, DATA)
    assert [c for c in plan(own).split("\n") if "RepartitionByExpression" in c and "o_orderkey" in c]
    # the texts are computed above the exchange, of four columns
    below = plan(own)[plan(own).index("RepartitionByExpression") :]
    assert "Поставщик" not in below
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    monkeypatch.setattr(forms, "TASK_ROWS", n // 20)
    assert f", {-(-n // (n // 20))}" in [c for c in plan(forms.values(spark, DATA)).split("\n") if "RepartitionByExpression" in c][0]


def test_a_match_within_a_function_of_elements_is_sought_once(spark):
    own = spark.sql("select array('a1 b2') as x").select(F.transform("x", lambda x: rx.find(rx.find(x, r"[a-z][0-9].*"), r"[0-9]")).alias("y"))
    assert plan(own).count("regexp_extract(") == 2
    assert own.first().y == ["1"]


def test_a_heading_is_taken_apart_once(spark):
    own = spark.sql("select '1. Грузоотправитель\nООО' as text").select(sections.pieces_of(F.col("text")).alias("p"))
    assert plan(own).count("split(") == 2
    assert [p.title for p in own.first().p.parts] == ["Грузоотправитель"]


def test_one_reading_of_the_orders_gives_the_forms_of_split_anchors(spark):
    assert plan(catalog.split_anchors(spark, DATA)).count("o_orderdate") == plan(forms.rendered(spark, DATA)).count("o_orderdate")
    assert "Join" not in plan(catalog.split_anchors(spark, DATA)).replace("Join Inner, (o_custkey", "")


def test_a_misread_title_is_judged_once(spark):
    assert "Aggregate [title" in plan(catalog.header_fuzzy(spark, DATA))


def test_early_decisions_agree_with_all_windows(spark):
    own = random.Random(7)
    names = [n for _, titles in fuzzy.TITLES for n in titles]
    titles = set()
    for _ in range(600):
        t = list(own.choice(names) + own.choice(["", "", " " + own.choice(names), ": ООО", " груза", " и " + own.choice(names)[:6]]))
        for _ in range(own.randrange(6)):
            i = own.randrange(len(t))
            t[i : i + own.randrange(2)] = own.choice(["", "", "ъ", "е", "о", " "])
        titles.add("".join(t))
    got = spark.createDataFrame([(t,) for t in sorted(titles)], "t string").select("t", fuzzy.fuzzy_roles("array(t)")[0].alias("role")).collect()
    wrong = [(r.t, r.role, fuzzy.fuzzy_role(r.t)) for r in got if r.role != fuzzy.fuzzy_role(r.t)]
    assert not wrong and len({r.role for r in got}) == 6


def test_steps_that_a_test_guards_still_change_what_they_should(spark):
    texts = {"a‪б": "aб", "при-—": "при-—", "x−  \n y": "xy", "a \t b": "a b", "a\r\r\nb": "a\nb", "Хoд": "Ход"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textnorm.normalize(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts | {"a‪б": "аб"}
    lines = ["ООО  Ромашка\x1f мир", "x'y аbв \"_'|", "чистая строка", "   "]
    own = spark.createDataFrame([(t,) for t in lines], "t string").select("t", textnorm.clean_line(F.col("t")).alias("a"), F.when(~textnorm.is_noise_line(F.col("t")), textnorm.strip_garbage_tokens(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in own)


def test_only_wanted_sections_are_joined(spark):
    own = spark.sql("select '1. Грузоотправитель\nООО\n7. Транспортное средство: МАЗ\nА123ВС77\n8. Прием груза\nТула' as text")
    # what bodies are stripped of and joined with grows with the sections that are asked for
    few, every = (plan(sections.add_sections(own, wanted=x)).count("array_join(") for x in (["vehicle"], sections.ROLES))
    assert few < every
    assert sections.add_sections(own, wanted=["vehicle"]).select("sections.*").first().asDict() == {"vehicle": "МАЗ\nА123ВС77"}
    assert sections.add_sections(own).select("sections.*").first().asDict() == {"head": None, "shipper": "ООО", "consignee": None, "cargo": None, "carrier": None, "vehicle": "МАЗ\nА123ВС77", "reception": "Тула"}
    assert plan(catalog.QUERIES["extract_vehicle"](spark, DATA)).count("array_join(") < plan(catalog.QUERIES["waybill_pipeline"](spark, DATA)).count("array_join(")


def test_roles_of_the_heading_scan_are_those_of_the_rule(spark):
    rnd = random.Random(5)
    titles = [t for _, own in fuzzy.ROLE_TITLES for t in own] + sections.STOP_TITLES + ["грузовик", "грузоопуч", "грузотпр", "раздел", "груз\xa0", "груз\t", "груз\x0b", "груз\x0bа"]
    texts = ["1. груз" + "\x0b" * 77 + "я", "1. груз" + "\x0b" * 76 + "я", "1. груз" + "\x0b" * 90]
    for _ in range(1500):
        t = list(rnd.choice(titles))
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice(["", "о", t[i] * 2, " ", ":"])
        x = "".join(t)
        texts.append(rnd.choice(["", "7. ", "3 ", "12) ", " 8\xa0. "]) + rnd.choice([x, x.capitalize(), x.upper()]) + rnd.choice(["", " ", ":", " x", "/", "ово", "\x1c", " " * 90]))
    # one scan finds the headings and tells their roles: no title is judged by a list of beginnings unless it has no number
    own = spark.createDataFrame([(x,) for x in texts], "x string").select(F.explode(sections.pieces_of(F.col("x"))["parts"]).alias("p"))
    got = own.select("p.*", sections.exact_role(F.col("p.title")).alias("rule")).collect()
    assert len(got) > 800 and {g["rank"] for g in got} == {1, 2, 3} and all(g.role == g.rule for g in got)
    assert "(?=(?:(" in plan(own)


def test_a_steady_text_is_told_by_one_scan(spark):
    rnd = random.Random(8)
    parts = ["слово", " ", "\n", "-", "—", "№ 1", "a", "х", "\t", "\r", "\xa0", "​", "", ".", "і", "z", "\x1c", " "]
    texts = ["".join(rnd.choices(parts[:7] if i % 2 else parts, k=rnd.randrange(9))) for i in range(1500)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    steps = textnorm.fix_lookalikes(textnorm.collapse_spaces(textnorm.join_hyphen_breaks(F.replace(F.replace(textnorm.strip_invisible(F.col("t")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))))
    got = df.select("t", rx.has(F.col("t"), textnorm._STEADY, "").alias("steady"), steps.alias("steps"), textnorm.normalize(F.col("t")).alias("n"), rx.strip(steps).alias("all")).collect()
    assert all(r.steps == r.t for r in got if r.steady) and all(r.n == r["all"] for r in got) and 100 < sum(r.steady for r in got) < 1400
