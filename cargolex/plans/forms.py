"""Waybill texts rendered from the order tables, with the defects that scans have, so that the parser's results have an exact answer.

The values of a form are SQL expressions over orders and customers that Spark and other engines read alike; the form's text is made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validate import FORM_DATES, WEIGHTS_10

#: Order dates are moved into the years that a waybill may have.
AS_OF_YEAR, MONTHS = 2026, 300
DEFECTS = 8
_CITIES = "Москва,Казань,Тула,Пермь,Омск,Самара,Уфа,Чита"
_SURNAMES = "Иванов,Петров,Сидоров,Орлов,Козлов,Захаров,Николаев,Рябов"
_LETTERS = "АВЕКМНОРСТУХ"


def _tax_id(base: str) -> str:
    total = " + ".join(f"{w} * cast(substr({base}, {i + 1}, 1) as int)" for i, w in enumerate(WEIGHTS_10))
    return f"{base} || cast((({total}) % 11 % 10) as string)"


def _nine(prefix: int, key: str) -> str:
    return f"cast({prefix}00000000 + {key} % 1000000 as string)"


def _two(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


#: name of a value -> SQL over orders (o_) joined with customer (c_).
VALUES = {
    "defect": f"cast(o_orderkey % {DEFECTS} as int)",
    "number": "cast(o_orderkey as string) || '-' || cast(o_custkey as string)",
    "shipper_name": "'ООО «Поставщик-' || cast(o_custkey % 97 as string) || '»'",
    "shipper_place": f"'г. ' || split_part('{_CITIES}', ',', cast(o_custkey % 8 + 1 as int)) || ', ул. Складская, д. ' || cast(o_custkey % 50 + 1 as string)",
    "shipper_inn": _tax_id(_nine(7, "(o_custkey * 7)")),
    "consignee_name": "'АО «Покупатель-' || cast(c_nationkey as string) || '»'",
    "consignee_place": f"'г. ' || split_part('{_CITIES}', ',', cast(c_nationkey % 8 + 1 as int)) || ', ул. Центральная, д. ' || cast(o_orderkey % 90 + 1 as string)",
    "consignee_inn": _tax_id(_nine(5, "(o_custkey * 3)")),
    "cargo_name": "'Изделие стальное марки СТ-' || cast(o_orderkey % 400 as string)",
    "places": "cast(o_orderkey % 60 + 1 as string)",
    "weights": f"'Нетто — ' || cast(o_custkey % 20 + 1 as string) || ',' || {_two('o_orderkey % 100')} || ' т., Брутто — ' || cast(o_custkey % 20 + 2 as string) || ',' || {_two('o_orderkey % 100')} || ' т., Объём — ' || cast(o_orderkey % 9 + 1 as string) || ' м³'",
    "driver": f"split_part('{_SURNAMES}', ',', cast(o_orderkey % 8 + 1 as int)) || ' ' || substr('{_LETTERS}', cast(o_custkey % 12 + 1 as int), 1) || '.' || substr('{_LETTERS}', cast(o_orderkey % 12 + 1 as int), 1) || '.'",
    "plate": f"substr('{_LETTERS}', cast(o_orderkey % 12 + 1 as int), 1) || lpad(cast(o_custkey % 1000 as string), 3, '0') || substr('{_LETTERS}', cast(o_custkey % 12 + 1 as int), 1) || substr('{_LETTERS}', cast(c_nationkey % 12 + 1 as int), 1) || {_two('o_orderkey % 99 + 1')}",
    "terminal_name": "'ООО «Терминал-' || cast(o_orderkey % 31 as string) || '»'",
    "terminal_place": "'г. Тула, ул. Портовая, д. ' || cast(o_custkey % 40 + 1 as string)",
    "terminal_inn": _tax_id(_nine(4, "(o_orderkey * 5)")),
}
SPARK_DATE = f"date_format(add_months(o_orderdate, {MONTHS}), 'dd.MM.yyyy')"
SQL_DATE = f"strftime(o_orderdate + interval {MONTHS} month, '%d.%m.%Y')"

#: What the parser is to find: field -> (value, confidence) as SQL over the values, `day` being the date.
EXPECTED = {
    "date": (f"case when day in ({', '.join(repr(d) for d in FORM_DATES)}) then null else day end", "1.0"),
    "number": ("number", "case when defect = 2 then 0.8 else 0.9 end"),
    "shipper": ("shipper_name || ', ' || shipper_place || ', ИНН ' || shipper_inn", "0.9"),
    "consignee": ("case when defect = 4 then null else consignee_name || ', ' || consignee_place end", "0.9"),
    "cargo": ("cargo_name", "0.9"),
    "volume": ("places || ' мест, ' || weights", "0.9"),
    "driver": ("driver", "1.0"),
    "vehicle": ("plate", "1.0"),
    "reception": ("terminal_name || ', ' || terminal_place || ', ИНН ' || terminal_inn", "0.9"),
}


def _tax_id_number(prefix: int, key: str) -> str:
    """The tax id of _tax_id(_nine(prefix, key)), its check digit from the digits of a number instead of a text's; the second and third are 0."""
    n = f"({key} % 1000000)"
    digits = " + ".join(f"{w} * ({n} div {10 ** (5 - i)} % 10)" for i, w in enumerate(WEIGHTS_10[3:]))
    return f"cast(({prefix}00000000 + {n}) * 10 + ({WEIGHTS_10[0] * prefix} + {digits}) % 11 % 10 as string)"


#: What Spark computes in a cheaper way than the SQL of VALUES tells.
SPARK_VALUES = VALUES | {"shipper_inn": _tax_id_number(7, "(o_custkey * 7)"), "consignee_inn": _tax_id_number(5, "(o_custkey * 3)"), "terminal_inn": _tax_id_number(4, "(o_orderkey * 5)")}


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys are dealt before the values are computed, so that no text is shuffled."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    both = dealt(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), orders)
    return both.select("o_orderkey", "o_custkey", F.expr(SPARK_DATE).alias("day"), *(F.expr(x).alias(k) for k, x in SPARK_VALUES.items()))


def values_sql() -> str:
    return f"select o_orderkey, o_custkey, {SQL_DATE} as day, {', '.join(f'{x} as {k}' for k, x in VALUES.items())} from orders join customer on o_custkey = c_custkey"


def expected_sql(fields: list[str]) -> str:
    own = [f"{EXPECTED[f][0]} as {f}, cast(case when ({EXPECTED[f][0]}) is null then 0.0 else {EXPECTED[f][1]} end as double) as {f}_conf" for f in fields]
    return f"select o_orderkey, o_custkey, defect, {', '.join(own)} from ({values_sql()})"


def _case(defect: int, then: Column | str, otherwise: Column | str) -> Column:
    own = [x if isinstance(x, Column) else F.lit(x) for x in (then, otherwise)]
    return F.when(F.col("defect") == defect, own[0]).otherwise(own[1])


def form() -> Column:
    """The text of a form. Defects: 1 Latin look-alikes, 2 no number sign, 3 no dots, 4 no consignee, 5 a misread title, 6 broken words, 7 noise."""
    c, dot = F.col, _case(3, " ", ". ")
    spaced = F.translate(F.regexp_replace("plate", r"^(.)(...)(..)(..)$", "$1 $2 $3 $4"), _LETTERS, "ABEKMHOPCTYX")
    lines = [
        F.lit("Транспортная накладная"),
        _case(2, F.concat(c("day"), F.lit("\n"), c("number")), F.concat(F.lit("№ "), c("number"), F.lit(" от "), c("day"))),
        F.lit("Экземпляр № 1"),
        F.concat(F.lit("1"), dot, F.when(c("defect") == 1, "Гpузooтпpaвитeль").when(c("defect") == 5, "Грузотравитель").otherwise("Грузоотправитель")),
        F.lit("(реквизиты, позволяющие идентифицировать)"),
        c("shipper_name"),
        c("shipper_place"),
        F.concat(F.lit("ИНН "), c("shipper_inn"), F.lit(", КПП 770101001")),
        _case(4, F.lit(None).cast("string"), F.concat(F.lit("2"), dot, F.lit("Грузополучатель\n"), c("consignee_name"), F.lit("\n"), c("consignee_place"), F.lit("\nИНН "), c("consignee_inn"))),
        F.concat(F.lit("3"), dot, F.lit("Груз")),
        F.concat(F.lit("Наименование: "), _case(6, F.regexp_replace("cargo_name", "Изделие сталь", "Изде-\nлие ста­ль"), c("cargo_name"))),
        F.concat(F.lit("Кол-во мест: "), c("places")),
        c("weights"),
        F.concat(F.lit("4"), dot, F.lit("Сопроводительные документы\nпаспорт качества")),
        F.concat(F.lit("6"), dot, F.lit("Перевозчик\nООО «Трансавто»\nВодитель: "), c("driver")),
        F.concat(F.lit("7"), dot, F.lit("Транспортное средство\n"), _case(1, spaced, c("plate"))),
        F.concat(F.lit("8"), dot, F.lit("Прием груза")),
        _case(7, "іі-і Ц:і '|_'", F.lit(None).cast("string")),
        c("terminal_name"),
        c("terminal_place"),
        F.concat(F.lit("ИНН "), c("terminal_inn")),
        F.concat(F.lit("9"), dot, F.lit("Выдача груза\nсклад получателя")),
    ]
    return F.concat_ws("\n", *lines)


#: What is to be found in a form without sections, whose fields stand behind their names: field -> (value, confidence).
LOOSE = 3
LOOSE_EXPECTED = {
    "date": (EXPECTED["date"][0], f"case when o_orderkey % {LOOSE} = 2 then 0.5 else 0.7 end"),
    "number": ("number", f"case o_orderkey % {LOOSE} when 0 then 0.6 when 1 then 0.55 else 0.5 end"),
    "shipper": ("shipper_name || ', ' || shipper_place || ', ИНН ' || shipper_inn", "0.5"),
    "consignee": ("consignee_name || ', ' || consignee_place", "0.5"),
    "driver": ("driver", "0.5"),
    "vehicle": ("plate", "0.6"),
    "reception": ("terminal_name || ', ' || terminal_place || ', ИНН ' || terminal_inn", "0.5"),
}


def loose_form() -> Column:
    """A form that lost its numbered titles: the number behind a sign, on a line of its own, or without the form's heading."""
    c, k = F.col, F.col("o_orderkey") % LOOSE
    signed = F.concat(F.lit("№ "), c("number"), F.lit(" от "), c("day"))
    lines = [
        F.when(k == 0, F.concat(F.lit("Транспортная накладная\n"), signed)).when(k == 1, F.concat(F.lit("Транспортная накладная\n"), c("day"), F.lit("\n"), c("number"))).otherwise(signed),
        F.concat(F.lit("Грузоотправитель: "), c("shipper_name"), F.lit(", "), c("shipper_place"), F.lit(", ИНН "), c("shipper_inn")),
        F.concat(F.lit("Грузополучатель\n"), c("consignee_name"), F.lit(", "), c("consignee_place")),
        F.concat(F.lit("Псревозчик ООО «Трансавто», водитель "), c("driver")),
        F.concat(F.lit("автомобиль "), c("plate")),
        F.lit("Прием груза"),
        c("terminal_name"),
        c("terminal_place"),
        F.concat(F.lit("ИНН "), c("terminal_inn")),
    ]
    return F.concat_ws("\n", *lines)


def loose_sql() -> str:
    own = [f"{v} as {f}, cast(case when ({v}) is null then 0.0 else {conf} end as double) as {f}_conf" for f, (v, conf) in LOOSE_EXPECTED.items()]
    return f"select o_orderkey, {', '.join(own)} from ({values_sql()})"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, defect, text): a form for each order."""
    return values(spark, sf_dir).select("o_orderkey", "defect", form().alias("text"))


#: Forms that one task reads, at most about.
TASK_ROWS = 25_000


def dealt(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows with an order's key, one for each row of a table that is counted by its footers: reading a form costs far more than moving a key, so they
    are dealt to all cores and, of large tables, to tasks that stay as long however many orders there are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-counted.count() // TASK_ROWS)), "o_orderkey")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt over all cores. Larger inputs stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
