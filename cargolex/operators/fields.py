"""The business fields of a waybill: each from its section, else from the whole text, with a confidence.

A field is a struct (value, conf); the value is NULL and the confidence 0 where nothing was found. Every extractor is a column expression, so
fields that a query does not ask for are not computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.orglines import NAMED_TAX_ID, NEIGHBOUR, ORG, SERVICE, WORD_DATE_OR_NUMBER, cut_after_tax_id, cut_before_registry, is_noisy, meaningful_lines, party_lines, trim_to_org
from ..functions.rx import before, behind, filled, find, first_match, first_of, has, let, lines, matches, position, replace, strip
from ..functions.textnorm import clean_value, is_garbage, strip_garbage_tokens
from ..functions.validate import compact_plate, first_date
from ..schema import FIELDS, is_blank

_DASH = r"\-–—‐-―−"
# The heading, signs before a number, decrees whose numbers are printed on forms.
HEADING = r"транспортн(?:ая|ой)\s+накладн(?:ая|ой)"
_SIGN, _NUMBER = r"(?:№|N(?<=\b.)o\.?)", r"[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\-_/.]"
NUMBER_FORMS = [rf"{_SIGN}\s*\n?\s*({_NUMBER}{{0,48}})", rf"{_SIGN}\s*[:\-–—]?\s*({_NUMBER}{{0,48}})", rf"{_SIGN}[ \t|:\-–—_.]{{0,8}}({_NUMBER}{{1,48}})"]
DECREES = ["1137", "2116", "2200", "2311", "272", "534", "1117"]
# Names of people, units of pieces, labels of the cargo section, the line of weights, what ends the reception section, labels of plates.
# Here and in the sign, a word's beginning is asked for behind its first letter, so that it is not looked for at every character.
PERSON = r"[А-ЯЁ](?<=\b.)(?:[а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.|\.\s?[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]+|[а-яё]{2,}\s+[А-ЯЁ]\.(?!\s?[А-ЯЁ]))"
FULL_NAME = r"\b[A-Za-zА-ЯЁа-яё]{3,14}[ \t]+[А-ЯЁ][а-яё]{2,14}[ \t]+[А-ЯЁ][а-яё]{2,14}\b"
PIECES = r"(?:шт|штт|нтт|нт)"
CARGO_END = r"(?:класс\s+опасност|упаковк|тара\b|способ\s+(?:погрузк|упаковк)|условия\s+(?:хранен|перевозк)|маркировк|номер\s+контейнер)"
NUMBER_OF_PLACES = r"\bкол[-\s]?во\s+мест\b|\bколичество\s+мест\b"
CARGO_LABEL = rf"^[^\nа-яёА-ЯЁa-zA-Z]{{0,8}}(?:[0-9]+[.)]\s*)?[а-яА-Я\-\^'\"«»„]{{0,3}}?н.{{1,5}}мен\w*\s*[:{_DASH}]+\s*(.*)$"
CARGO_ROOT = r"мен[оае]ван\w*"
MEASURE = r"^(ед\.\s*изм|кол-во|количес|масс|объ[её]м|нетто|брутто|в том числе)\b"
WEIGHTS = r"нетто[^\n]*брутто[^\n]*(?:объ[её]м|м[³3])[^\n]*"
RECEPTION_STOP = r"\n\s*(?:[0-9]{1,2}\s*[.)]\s*(?:выдача\s+груз|переадресовк|отметк|стоимость|прочие\s+условия)|сдач\w*\s+груз|выдач\w*\s+груз|доставк\w*\s+груз|переадресовк|отметк\w+\s+грузоотпр)"
PLATE_LABELS = [rf"{x}\s*[:\-–—]?\s*([^\n\r]{{2,40}})" for x in (r"гос\.?\s*номер", r"рег\.?\s*знак", r"государственн\w*\s+регистрационн\w*\s+номер")]


def found(value: Column, conf: Column | float) -> Column:
    """A field; NULL if it has no value."""
    sure = conf if isinstance(conf, Column) else F.lit(conf)
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), sure.cast("double").alias("conf"))))


def or_missing(field: Column) -> Column:
    """A field that was not found has no value and the confidence 0."""
    return F.coalesce(field, F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("conf")))


#: The first way to find a field that gives a value.
_either = F.coalesce


def _value(c: Column) -> Column:
    """NULL for what is empty or garbage."""
    return let(c, lambda v: F.when(~is_garbage(v), v))


# number and date


def _of_the_form(region: Column, m: Column) -> Column:
    """Whether what stands left of a number says that it belongs to the form: a copy, an annex, a decree."""

    def judged(left: Column) -> Column:
        line = F.regexp_extract(left, r"[^\n]*\z", 0)
        near, wide = F.right(line, F.lit(20)), F.right(left, F.lit(300))
        decree = wide.contains("постановлен") | (wide.contains("правительств") & wide.contains("рф")) | wide.contains("в ред.") | wide.contains("к правилам")
        annex = wide.contains("приложени") & has(wide, "1137|2116|2200|534", "")
        told = has(near, r"экземпляр|экз\.", "") | has(line, r"приложение|прил\.|постановлен|договор|к правилам", "") | decree | annex
        return F.when(strip(left) != "", told).otherwise(F.lit(False))

    return let(F.lower(F.substring(region, F.lit(1), m["at"])), judged)


def pick_number(region: Column) -> Column:
    """The first number of a region that is not the form's own; stricter forms of writing it go first."""

    def good(found: Column, form: str) -> Column:
        own = F.transform(F.filter(found, lambda m: ~_of_the_form(region, m)), lambda m: strip(find(m["found"], f"\\A(?:{form})", 1), r"\s.,:;"))
        return first_of(own, lambda x: has(x, "[0-9]", "") & ~x.isin(DECREES))

    # if the first match of the strictest form is good, no other has to be found
    first = let(first_match(region, NUMBER_FORMS[0]), lambda m: F.when(m.isNotNull(), good(F.array(m), NUMBER_FORMS[0])))
    return F.when(has(region, _SIGN), F.coalesce(first, *(good(matches(region, form), form) for form in NUMBER_FORMS)))


def number_without_sign(tail: Column) -> Column:
    """The first of ten lines that is one word with a digit, neither a date nor the form's own."""
    own = F.transform(F.slice(lines(tail), 1, 10), lambda x: strip(x, r" \t|—–\-\[\]()"))
    service = r"^(?:транспортн|заказ|дата|экземпляр|№|no|приложение)|накладн"
    good = first_of(own, lambda x: F.length(x).between(2, 50) & ~has(x, service) & ~has(x, r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}\z", "") & has(x, rf"^{_NUMBER}{{1,48}}\z", "") & has(x, "[0-9]", ""))
    return filled(strip(good, r" .,:;"))


def heading_tail(head: Column, text: Column) -> Column:
    """The 500 characters behind the waybill's heading, in the head section if there is one; NULL without a heading."""
    return let(F.coalesce(head, text), lambda source: let(first_match(source, HEADING), lambda m: behind(source, m, 500)))


def number(head: Column, text: Column) -> Column:
    def behind(tail: Column) -> Column:
        signed = found(pick_number(tail), F.when(head.isNotNull(), 0.9).otherwise(0.6))
        return _either(signed, found(number_without_sign(tail), F.when(head.isNotNull(), 0.8).otherwise(0.55)))

    return _either(let(heading_tail(head, text), behind), found(pick_number(F.substring(text, 1, 1200)), 0.5))


def date(head: Column, text: Column, as_of_year: int) -> Column:
    near = found(first_date(heading_tail(head, text), as_of_year), F.when(head.isNotNull(), 1.0).otherwise(0.7))
    return _either(near, found(first_date(text, as_of_year), 0.5))


# parties


def _fallback_party(text: Column, keyword: str) -> Column:
    """What stands on the line of a keyword or the next one, up to a neighbouring field."""
    own = strip(find(text, rf"{keyword}\s*[:\-–—]?\s*\n?\s*([^\n\r]{{2,500}})", 1))
    cut = let(own, lambda x: F.when(position(x, NEIGHBOUR) > 0, strip(before(x, NEIGHBOUR), r" ,;:\-–—")).otherwise(x))
    return let(cut, lambda x: F.when((x != "") & ~has(x, SERVICE), x))


def _short(c: Column) -> Column:
    return _value(strip(F.substring(c, 1, 500), r" ,;"))


def _with_tax_id(c: Column) -> Column:
    return let(trim_to_org(c), lambda x: _short(F.coalesce(filled(cut_after_tax_id(x)), cut_before_registry(x))))


def _without_tax_id(c: Column) -> Column:
    return let(trim_to_org(c), lambda x: _short(cut_before_registry(x)))


def shipper(section: Column, text: Column) -> Column:
    return _either(found(_with_tax_id(party_lines(section)), 0.9), found(_with_tax_id(_fallback_party(text, "грузоотправитель")), 0.5))


def consignee(section: Column, text: Column) -> Column:
    return _either(found(_without_tax_id(party_lines(section)), 0.9), found(_without_tax_id(_fallback_party(text, "грузополучатель")), 0.5))


# cargo


def clean_cargo(c: Column) -> Column:
    """A cargo's name without the number of places, a quantity at its end and the attributes behind it."""
    edge = r" ,;\-–—"
    own = strip(before(c, NUMBER_OF_PLACES), edge)
    own = strip(replace(own, rf",?\s*[0-9]+(?:[,.][0-9]+)?\s*{PIECES}\.?\s*$", ""), edge)
    own = strip(before(own, rf"\b{CARGO_END}"), edge)
    return strip(F.substring(own, 1, 400), r" ,;")


def _labelled_cargo(own: Column) -> Column:
    """The value of the first label; a label without one takes the next line that can be a name."""

    def step(acc: Column, x: Column) -> Column:
        label = has(x, CARGO_LABEL)
        root = has(x, CARGO_ROOT)
        behind = filled(strip(find(x, CARGO_LABEL, 1)))
        behind_root = filled(strip(find(x, rf"{CARGO_ROOT}[\s:{_DASH}]+\s*(.+)", 1)))
        word = has(x, r"^груз(?::| —| -)")
        behind_word = filled(strip(F.get(F.split(x, r"[:\-–—]", 2), F.lit(1))))
        usable = acc["waits"] & ~has(x, MEASURE) & ~has(x, NUMBER_OF_PLACES) & has(x, "[А-Яа-яЁёA-Za-z]{3,}", "")
        value = F.when(label, behind).when(root, behind_root).when(word, behind_word).when(usable, strip(replace(x, rf"^[\s:{_DASH}]+", "")))
        told = lambda waits, value, over: F.struct(waits.alias("waits"), value.alias("value"), over.alias("over"))
        end = acc["over"] | acc["value"].isNotNull() | has(x, rf"^{CARGO_END}")
        return F.when(end, told(acc["waits"], acc["value"], F.lit(True))).otherwise(told(acc["waits"] | label | root, value, F.lit(False)))

    start = F.struct(F.lit(False).alias("waits"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("over"))
    return F.aggregate(own, start, step, lambda acc: acc["value"])


def _first_cargo_line(own: Column) -> Column:
    stop = F.array_position(F.transform(own, lambda x: has(x, rf"^{CARGO_END}")), True).cast("int")
    usable = let(stop, lambda n: F.when(n > 0, F.slice(own, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(own))
    return first_of(usable, lambda x: ~has(x, MEASURE) & has(x, "[А-Яа-яЁёA-Za-z]{3,}", ""))


def cargo(section: Column, text: Column) -> Column:
    named = let(meaningful_lines(section), lambda own: _value(clean_cargo(F.coalesce(_labelled_cargo(own), _first_cargo_line(own)))))
    labels = [rf"н.{{1,5}}мен\w*\s+груз\w*\s*[:{_DASH}]+\s*([^\n\r]{{2,400}})", rf"н.{{1,5}}мен\w*\s*[:{_DASH}]+\s*([^\n\r]{{2,400}})"]
    return _either(found(named, 0.9), found(F.coalesce(*(_value(clean_cargo(strip(find(text, x, 1)))) for x in labels)), 0.5))


def volume(section: Column, text: Column) -> Column:
    """Places, pieces, and the line of weights, as far as they are there."""

    def of(source: Column) -> Column:
        places = find(source, r"кол[-\s]?во\s+мест\s*[—:\-–‐-―−]?\s*([0-9]+)", 1)
        pieces = strip(find(source, rf"\b([0-9]+(?:[,.][0-9]+)?\s*{PIECES}\.?)", 1))
        return filled(F.concat_ws(", ", F.concat(places, F.lit(" мест")), pieces, strip(find(source, WEIGHTS), r" ,;")))

    return _either(found(of(section), 0.9), found(of(text), 0.5))


# people, vehicles, reception


def _full_name(c: Column) -> Column:
    """The first full name that no "ИП" stands before."""
    left = lambda m: F.substring(c, F.greatest(m["at"] - 4, F.lit(1)), F.least(m["at"], F.lit(5)))
    return strip(first_of(matches(c, FULL_NAME, ""), lambda m: ~has(left(m), r"ип[ \n]"))["found"])


def driver(section: Column, text: Column) -> Column:
    short = lambda c: strip(find(c, PERSON, 0, ""))
    window = F.substring(text, position(text, r"п[ес][рст]евоз\w{0,5}") + 1, F.lit(1500))
    beside = let(window, lambda w: _either(found(short(w), 0.5), found(_full_name(w), 0.4)))
    return _either(found(short(section), 1.0), found(_full_name(section), 0.9), beside)


def vehicle(section: Column, text: Column) -> Column:
    labelled = F.coalesce(*(let(clean_value(find(text, x, 1)), lambda v: F.when(~is_blank(v), v)) for x in PLATE_LABELS))
    return _either(found(compact_plate(section), 1.0), found(compact_plate(text), 0.6), found(labelled, 0.4))


def _collected(own: Column) -> Column:
    """From the first line with a legal form, four lines or up to a tax id."""

    def taken(start: Column) -> Column:
        some = F.slice(own, F.greatest(start, F.lit(1)), F.lit(4))
        last = F.array_position(F.transform(some, lambda x: has(x, NAMED_TAX_ID) | has(x, r"\b[0-9]{10,12}\b")), True).cast("int")
        return F.when(F.size(own) > 0, F.array_join(let(last, lambda n: F.when(n > 0, F.slice(some, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(some)), ", "))

    return filled(let(F.array_position(F.transform(own, lambda x: has(x, ORG)), True).cast("int"), taken))


def _trimmed(c: Column) -> Column:
    own = replace(trim_to_org(c), r",\s*ин{1,2}\.?\s*,?\s*(?=[0-9]{10,12}\b)", ", ИНН ")
    plain = lambda x: strip(find(x, r"^.*?\b[0-9]{10,12}\b", 0, "s"), r" ,;")
    own = let(own, lambda x: F.coalesce(filled(cut_after_tax_id(x)), plain(x), cut_before_registry(x)))
    return strip(F.substring(replace(own, r",\s*[А-Яа-яЁёA-Za-z]{1,3}\.?\s*$", ""), 1, 500), r" ,;")


def reception(section: Column, text: Column) -> Column:
    clear = F.filter(lines(before(section, RECEPTION_STOP)), lambda x: ~is_noisy(x))
    cleaned = F.filter(F.transform(clear, lambda x: strip_garbage_tokens(strip(x))), lambda x: (F.length(x) > 3) & has(x, WORD_DATE_OR_NUMBER, ""))
    chunk = let(first_match(text, r"при[ёе]м\s+груз\w*"), lambda m: behind(text, m, 1500))
    beside = F.filter(F.transform(F.filter(lines(before(chunk, RECEPTION_STOP)), lambda x: ~is_noisy(x)), lambda x: strip(x)), lambda x: x != "")
    return _either(found(_value(_trimmed(let(cleaned, _collected))), 0.9), found(_value(_trimmed(let(beside, _collected))), 0.5))


#: The section that each field stands in.
SECTION = dict(zip(FIELDS, ["head", "head", "shipper", "consignee", "cargo", "cargo", "carrier", "vehicle", "reception"], strict=True))


def extracted(t: Column, s: Column, as_of_year: int, wanted: list[str] | None = None) -> dict[str, Column]:
    """A struct (value, conf) for each field of a waybill's text and its sections."""
    makers = {
        "date": lambda: date(s["head"], t, as_of_year),
        "number": lambda: number(s["head"], t),
        "shipper": lambda: shipper(s["shipper"], t),
        "consignee": lambda: consignee(s["consignee"], t),
        "cargo": lambda: cargo(s["cargo"], t),
        "volume": lambda: volume(s["cargo"], t),
        "driver": lambda: driver(s["carrier"], t),
        "vehicle": lambda: vehicle(s["vehicle"], t),
        "reception": lambda: reception(s["reception"], t),
    }
    return {f: or_missing(makers[f]()) for f in wanted or FIELDS}


def add_fields(docs: DataFrame, as_of_year: int, text: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """Adds the fields to rows with text and sections."""
    return docs.withColumns(extracted(F.col(text), F.col("sections"), as_of_year, wanted))
