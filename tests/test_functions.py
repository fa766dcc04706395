"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from cargolex.functions import fuzzy, orglines, textnorm, validate
from cargolex.operators import documents, sections

YEAR = 2026
CASES = {
    "normalize": (textnorm.normalize, {"ИHH Мapкa Тенsar HAи": "ИНН Марка Тенsar HАи", "При-\nём  груза\r\n\r\nтест ": "Приём груза\nтест", "a­b​c": "abc", "Бace yБ ayБ xyz": "Басе уБ aуБ xyz", "": "", None: None}),
    "garbage_token": (textnorm.is_garbage_token, {"іі-і": True, "Бекам'тбд": True, "ав4'": True, "café": True, "Тенsar": False, "RENAULT": False, "B30F300": False, "—": False, "...": False, "'|_'": True, "7743553262": False, "420111,": False}),
    "noise_line": (textnorm.is_noise_line, {"іі-і Ц:і": True, "нормальная строка": False, "": True, "одно іі-і": True, "два слова іі-і": False}),
    "strip_garbage": (textnorm.strip_garbage_tokens, {"ООО іі-і  Ромашка 'Г'чп ok": "ООО Ромашка ok", "": ""}),
    "clean": (textnorm.clean_value, {" :abc-": "abc", "--": "отсутствует", "!?": "неразборчиво", None: "отсутствует"}),
    "single_line": (textnorm.single_line, {"a\n\n b": "a b"}),
    "date": (lambda c: validate.is_valid_date(c, YEAR), {"28.02.2024": True, "30.02.2024": False, "01.01.2015": False, "01.01.2016": True, "31.12.2027": True, "1.1.2024": False, "01.01.2024 ": True, None: False}),
    "first_date": (lambda c: validate.first_date(c, YEAR), {"x 30.11.2021 y 05.06.2024": "05.06.2024", "нет": None}),
    "plate": (validate.compact_plate, {"P 814 HP 152": "Р814НР152", "ИНН7743553262": None, "А123АА77": "А123АА77", "АВ 1234 77": "АВ123477", "Я123АА77": None}),
    "format_plate": (validate.format_plate, {"А123АА77": "А 123 АА 77", "АВ123477": "АВ 1234 77", "x": "x"}),
    "tax_id": (validate.is_valid_tax_id, {"7736207543": True, "7736207544": False, "500100732259": True, "500100732258": False, "123": False, None: False}),
    "first_tax_id": (validate.first_tax_id, {"тел 8930679658 ИНН 7736207543": "7736207543", "ИНН 7736207544": None}),
    "after_tax_id": (orglines.cut_after_tax_id, {"ООО Р, ИНН 7736207543, КПП 1": "ООО Р, ИНН 7736207543", "ООО Р, ИНИ 7736207543, КПП": "ООО Р, ИНИ 7736207543", "ООО": None}),
    "before_registry": (orglines.cut_before_registry, {"ООО Р, ИНН 1": "ООО Р", "ООО Р, ИНИ 7736207543, КПП": "ООО Р", "ООО": "ООО"}),
    "trim_to_org": (orglines.trim_to_org, {"р/с ПАО СБЕРБАНК, " + "счёт " * 13 + "ООО «Ромашка»": "ООО «Ромашка»", "без": "без", "x 000 «Р»": "000 «Р»"}),
    "party": (orglines.party_lines, {"ООО Альфа\nПодпись Иванов": "ООО Альфа", "ООО «Р», ИНН 7736207543\nг. Москва 2. Грузополучатель ООО\nещё": "ООО «Р», ИНН 7736207543, г. Москва 2.", "": None, None: None}),
    "noisy": (orglines.is_noisy, {"11 [3] Т": True, "Нормальная строка с текстом": False, "аб": True}),
    "page": (documents.page_kind, {"": "blank", "Транспортная накладная " + "Грузоотправитель " * 8: "ttn_start", "Транспортная накладная " + "x" * 100: "ttn_cont", "Счет-фактура " + "Грузоотправитель " * 9: "upd", "Реестр " + "x" * 100: "registry"}),
    "title": (sections.exact_role, {"Груз": "cargo", "груз: x": "cargo", "Грузополучатель": "consignee", "грузстправитель": "shipper", "Прием груза": "reception", "Отметки": "__ignored__", "Что-то": "?", "грузовик": "?груз"}),
}


def test_matches_are_where_they_stand(spark):
    import re

    from cargolex.functions import rx

    texts = ["", "a1b22c", "12", "x", "1 2 3 \ue001 4", "é9é" * 50]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: [(m.at, m.found) for m in r.m] for r in df.select("i", rx.matches(F.col("x"), "[0-9]+").alias("m")).collect()}
    assert got == {i: [(m.start(), m[0]) for m in re.finditer("[0-9]+", x)] for i, x in enumerate(texts)}
    first = {r.i: r.m and (r.m.at, r.m.found) for r in df.select("i", rx.first_match(F.col("x"), "[0-9]+").alias("m")).collect()}
    assert first == {i: (got[i] or [None])[0] for i in got}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, cases = CASES[name]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    assert {r.i: r.y for r in df.select("i", f(F.col("x")).alias("y")).collect()} == dict(enumerate(cases.values()))


def test_similarity():
    assert fuzzy.ratio("грузовтиравитель", "грузоотправитель") == 87.5
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "b") == 0 and fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.fuzzy_role("Псревозчик") == "carrier" and fuzzy.fuzzy_role("Наименование") is None and fuzzy.fuzzy_role("Гру") is None


def test_common_subsequence_as_by_table():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choices("абв", k=rnd.randint(0, 9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.common(a, b) == t[-1][-1]
