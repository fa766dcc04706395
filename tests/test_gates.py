"""Rules that one scan stands in for: what it lets pass is what the rules say, and how often a plan asks."""

import random

from pyspark.sql import functions as F

from cargolex.functions import orglines, rx, textnorm, validate
from cargolex.operators import documents, fields, sections
from cargolex.plans import catalog

DATA = "/root/testdata/sf0.001"
PARTS = ["ООО", "«Ромашка»", "ПАО СБЕРБАНК", "г.", "Тула,", "ул.", "д.", "27", "ИНН", "4000000400", "№", "—", "..", "«»", ".,", "іі-і", "Тенsar", "x'y", "Ё", "м³", "заказчик услуг", "подпись", "М.П.", "(да)", "[x]", "да", "аб", "5", "/", "\xa0", "  ", "слово", "реквизиты", "|"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_lines(seed):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(PARTS) + rnd.choice([" ", " ", "", ", "]) for _ in range(rnd.choice([1, 2, 3, 5, 8]))) for _ in range(1500)})


def test_a_page_is_judged_once_for_its_kind_and_for_splitting(spark):
    assert plan(catalog.split_registries(spark, DATA)).count(documents.REGISTRY) == 1


def test_marks_of_invoices_and_registries_pass_the_one_scan_for_them(spark):
    marks = ["счет-фактура", "СЧЕТФАКТУРА", "Универсальный передаточный", "реестр", "РЕЕСТР", "отгрузочная спецификация", "Товарный реестр", "ᲃчет фактура", "накладная"]
    df = spark.createDataFrame([(x,) for x in marks], "x string")
    got = df.select(rx.has(F.col("x"), documents.MARKED_PAGE).alias("may"), (rx.has(F.col("x"), documents.INVOICE) | rx.has(F.col("x"), documents.REGISTRY)).alias("is")).collect()
    assert all(r.may or not r["is"] for r in got) and [r.may for r in got] == [True] * 8 + [False]


def test_plain_lines_are_what_the_rules_make_of_them(spark):
    df = spark.createDataFrame([(x,) for x in some_lines(4)], "x string").select(rx.strip(F.col("x")).alias("x"))
    got = df.select(rx.has(F.col("x"), orglines._PLAIN, "").alias("plain"), orglines.meaningful_lines(F.col("x")).alias("a"), orglines._judged_lines(F.array("x")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.plain for r in got) > 30


def test_clear_lines_are_not_noisy(spark):
    df = spark.createDataFrame([(x,) for x in some_lines(6)], "x string").select(rx.strip(F.col("x")).alias("x")).withColumn("clear", rx.has(F.col("x"), orglines._CLEAR, ""))
    share = F.size(F.filter(textnorm.tokens(F.col("x")), lambda t: F.length(t) <= 2)) / F.size(textnorm.tokens(F.col("x")))
    alnum = F.length(F.regexp_replace("x", r"[^\p{L}\p{N}]", "")) / F.length("x")
    own = df.filter("clear").select(share.alias("short"), F.size(textnorm.tokens(F.col("x"))).alias("n"), alnum.alias("alnum"), textnorm.noise_share(F.col("x")).alias("noise"), rx.has(F.col("x"), orglines.WORD_DATE_OR_NUMBER, "").alias("word")).collect()
    assert len(own) > 30 and all((r.n < 4 or r.short <= 0.6) and r.alnum >= 0.3 and r.noise == 0 and r.word for r in own)


def test_no_look_at_cases_where_a_pattern_has_no_letters():
    assert rx.rx(r"[ \t\xa0\x{2009}]+", "i") == r"(?d)[ \t\xa0\x{2009}]+"
    assert rx.rx("\n{2,}", "im").startswith("(?dm)") and rx.rx(r"\bинн", "i").startswith("(?dUiu)")


def test_breaks_share_no_letter(spark):
    texts = {"a-\nb-\nc": "ab-\nc", "при-\n ём — \nтри-\n\n4": "приём — \nтри-\n\n4", "а—\nб": "аб"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textnorm.join_hyphen_breaks(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts


def test_the_first_number_is_taken_without_looking_for_all(spark):
    texts = {"\n№ 12-а от 01.02.2024\n№ 13": "12-а", "\nк договору № 7\n№ 13": "13", "№ 2116 № 5/1": "5/1", "№\n77": "77", "без": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fields.pick_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts
    assert "(?s:.*)" in plan(df)  # the first match is looked for by itself


def test_rare_characters_are_looked_for_first(spark):
    texts = ["x P 814 HP 152 y", "ИНН7743553262", "АВ 1234 77", "а 123 вс\n77", "12А123ВС77", "Петров  П.П.", "xПетров П.П.", "П.П. Петров", "Иванов И. к", "от 01.02.2024", "№", "x01.02.2024"]
    names = r"(?:\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.|\b[А-ЯЁ]\.\s?[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]+|\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ]\.(?!\s?[А-ЯЁ]))"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", validate.compact_plate(F.col("t")).alias("plate"), rx.find(F.col("t"), fields.PERSON, 0, "").alias("a"), rx.find(F.col("t"), names, 0, "").alias("b"), rx.find(F.col("t"), validate.DATE, 1).alias("day")).collect()
    assert {r.t: r.plate for r in got if r.plate} == {"x P 814 HP 152 y": "Р814НР152", "АВ 1234 77": "АВ123477", "а 123 вс\n77": "А123ВС77", "12А123ВС77": "А123ВС77"}
    assert all(r.a == r.b for r in got) and [r.day for r in got if r.day] == ["01.02.2024"]
    # upper case is made once, and no character is asked what stands before it unless it is a space
    own = plan(df.select(validate.compact_plate(F.col("t"))))
    assert "(?<=[А-ЯЁA-Z0-9])" not in own and "(?=[^0-9]{1,2}[0-9]{3})" in own


def test_pages_are_judged_only_where_there_are_several(spark):
    page = "Транспортная накладная\nГрузоотправитель " + "x" * 100
    texts = {page: [], "Реестр " + page: [], "Реестр " + "x" * 100 + "\f" + page: [page], "\f": [], None: []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    own = df.select("t", documents.split_by_pages(F.col("t")).alias("d"))
    assert {r.t: r.d for r in own.collect()} == texts and "Contains(t" in plan(own)
