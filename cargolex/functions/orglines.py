"""Lines of a section that carry meaning, and the cuts around an organisation's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import before, behind, filled, find, first_of, has, let, lines, matches, position, replace, rx, strip, without_marks
from .textnorm import clean_line, is_garbage, is_noise_line
from .validate import TAX_ID, is_valid_tax_id

# Beginnings of service lines, of lines that end a party's details, and words of neighbouring fields.
SERVICE = r"^(?:является\s+(?:экспедитором|грузоотправителем)|\(\s*реквизиты\b|полное\s+наименование|сокращ\w*\s+наименование|наименование\s+(?:юр|лица)|фио\b|ф\.?и\.?о\.?|экземпляр\s*№?|реквизиты\s+документа|да\b|нет\b|заказчик\s+услуг\b|при\s+наличи[ии]\b|[\[\(][\s xх×✓✔][\]\)]|[\-–—=_\s]{3,}|\([а-яА-Я]+\))"
PARTY_END = r"^(?:подпис[ьиея]|м\.?\s*п\.?\b|печат[ьи]\b|контактн(?:ое|ый|ого)\s+лиц|дата\s+составлен|ответственн[оы]й\s+за|должност[ьи]\b|доверенност|ф\.?\s*и\.?\s*о\.?\s+(?:водител|ответствен|предста))"
NEIGHBOUR = r"\b(?:грузоотправител|грузополучател|перевозчик|транспортн(?:ое|ого)\s+средств|при[её]м\s+груз|выдач\w*\s+груз|переадресовк|сопроводительн|стоимость\s+(?:услуг|перевозк)|оговорк|отметк\w+\s+грузо|указан\w+\s+грузоотправ)"
# Legal forms (000 is a misread ООО), banks, and names of registry numbers.
ORG = r"(?:\b(?:ООО|ОАО|АО|ЗАО|ПАО|НКО|ПБОЮЛ|ИП|ТОО|КФХ|АНО|ЧУ|ФГУП|ГУП|МУП|ФГБУ|ГБУ|НОУ|АНПО)\b|\b000(?=\s*[«\"'“”„А-ЯЁ]))"
BANK = r"\b(?:СБЕРБАНК|ВТБ|АЛЬФА[-\s]?БАНК|ГАЗПРОМБАНК|РОССЕЛЬХОЗБАНК|ОТКРЫТИЕ|РОСБАНК|ТИНЬКОФФ|УРАЛСИБ|ПСБ|СОВКОМБАНК|БИН[-\s]?БАНК|МКБ|МОСКОВСКИЙ\s+КРЕДИТНЫЙ|РАЙФФАЙЗЕН|ЮНИКРЕДИТ)\b"
REGISTRY = r"\b(?:ИНН|КПП|ОГРН|ОКПО|ОКВЭД|БИК)\b"
NAMED_TAX_ID = r"\bИНН\s*[0-9]{10,12}"
MAIN_FORMS = r"\b(?:ООО|АО|ЗАО|ПАО|ИП|ПБОЮЛ)\b"

WORD_DATE_OR_NUMBER = r"[А-Яа-яЁёA-Za-z]{4,}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{5,}"
_EDGE = r" \t,;"


def is_service(line: Column) -> Column:
    """Blank, in brackets as a whole, or the beginning of a form's own text."""
    return let(strip(line), lambda own: (own == "") | has(own, r"^\(.+\)\s*$", "") | has(own, SERVICE))


#: A line that meaningful_lines keeps but for its edges: words, numbers, single spaces and signs (nothing in brackets), a word among them, no beginning of
#: the form's own text and no label of the customer. One scan for what the rules of meaningful_lines look for one after the other.
_SIGNS = r".,:;«»№—\-"
_PLAIN = rf"\A(?=[^\n]*?(?:[А-я]{{4}}|[0-9]{{5}}))(?iu:(?!{SERVICE[1:]})(?![^\n]*?заказчик))(?:(?:[А-я]+|[0123456789]+)[{_SIGNS}]*| (?! |\z)|[{_SIGNS}](?![{_SIGNS}])|[Ёё³])++\z"
#: A line that is_noisy does not call noisy: single spaces, a word or a long number, at most two signs and spaces in a row, and so few tokens of one or
#: two characters that they are at most three fifths.
_SHORT, _LONG = rf"[А-я0123456789Ёё{_SIGNS}]{{1,2}}", rf"[А-я0123456789Ёё{_SIGNS}]{{3,}}"
_CLEAR = rf"\A(?=[^\n]*?(?:[А-я]{{4}}|[0-9]{{5}}))(?![^\n]*?[ {_SIGNS}]{{3}})(?:(?:(?:{_SHORT} )?{_LONG}(?: (?!\z)|\z))+(?:{_SHORT}\z)?|(?:{_SHORT} )?{_LONG}(?: {_LONG})+ {_SHORT} {_SHORT})\z"


def meaningful_lines(body: Column) -> Column:
    """The lines of a section that are neither the form's own text nor noise, without the garbage tokens in them."""

    def kept(x: Column) -> Column:
        return F.when(has(x, _PLAIN, ""), strip(x, _EDGE)).otherwise(F.get(_judged_lines(F.array(x)), F.lit(0)))

    own = F.transform(F.transform(lines(F.coalesce(body, F.lit(""))), lambda x: strip(x)), kept)
    return F.filter(own, lambda x: x.isNotNull())


def _judged_lines(own: Column) -> Column:
    own = F.filter(own, lambda x: ~is_service(x))
    own = F.transform(own, lambda x: F.when(x.contains("("), replace(x, r"\s*\([^)]*реквизиты[^)]*\)\s*$", "")).otherwise(x))
    # the customer's label can stand before the name of the party
    own = F.transform(own, lambda x: F.when(has(x, r"заказчик\s+услуг"), find(x, rf"{MAIN_FORMS}.*$", 0, "is")).otherwise(x))
    own = F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: strip(x, _EDGE))
    own = F.transform(F.filter(own, lambda x: (F.length(x) > 3) & has(x, WORD_DATE_OR_NUMBER, "")), lambda x: strip(clean_line(x), _EDGE))
    return F.filter(own, lambda x: (F.length(x) > 3) & ~is_garbage(x))


def is_noisy(line: Column) -> Column:
    """Whether a line of the reception section is noise of table borders."""

    def judged(s: Column) -> Column:
        alnum = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
        technical = F.length(s) - F.length(F.translate(s, "[](){}|\\/=_~^`<>*#$%", ""))
        few = lambda own: (F.size(own) >= 4) & (F.size(F.filter(own, lambda x: F.length(x) <= 2)) > 0.6 * F.size(own))
        return (
            (F.length(s) <= 3)
            | is_noise_line(s)
            | ~has(s, WORD_DATE_OR_NUMBER, "")
            | (alnum == 0)
            | (alnum < 0.3 * F.length(s))
            | ((technical >= 3) & (technical > 0.3 * F.length(s)))
            | let(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != ""), few)
        )

    return F.coalesce(let(strip(line), lambda s: F.when(has(s, _CLEAR, ""), F.lit(False)).otherwise(judged(s))), F.lit(True))


def _first_valid(s: Column) -> Column:
    return first_of(matches(s, TAX_ID, ""), lambda m: is_valid_tax_id(m["found"]))


def cut_after_tax_id(s: Column) -> Column:
    """Up to the end of the tax id: a named one, else a valid one after a short word, else a valid one; NULL without any."""
    named = find(s, rf"^.*?{NAMED_TAX_ID}", 0, "is")
    worded = find(s, rf"^.*?\b[A-Za-zА-Яа-яЁё]{{2,4}}\.?\s+(?:[0-9]{{10}}|[0-9]{{12}})\b", 0, "s")
    worded = let(worded, lambda x: F.when(is_valid_tax_id(find(x, r"([0-9]+)\z", 1, "")), x))
    bare = let(_first_valid(s), lambda m: F.substring(s, F.lit(1), m["at"] + F.length(m["found"])))
    return strip(F.coalesce(named, worded, bare), " ,;")


def cut_before_registry(s: Column) -> Column:
    """Up to the first name of a registry number, or four characters before the first valid tax id."""
    tax = let(F.when(has(s, "[0-9]{10}", ""), _first_valid(s)["at"]), lambda n: F.when(n.isNotNull(), F.greatest(n - 4, F.lit(0))))
    at = F.least(position(s, REGISTRY), tax)
    return let(at, lambda n: F.when(n.isNull(), s).otherwise(strip(F.substring(s, F.lit(1), n), r" ,;\-–—")))


def trim_to_org(s: Column) -> Column:
    """From the first legal form that is not a bank's on; all of it without one."""

    def cut(x: Column) -> Column:
        own = first_of(matches(x, ORG), lambda m: ~has(behind(x, m, 60), BANK))
        return F.coalesce(F.substring(x, own["at"] + 1, F.length(x)), x)

    def begins(x: Column) -> Column:
        """Whether a legal form that is not a bank's stands first, so that no other has to be found."""
        first = F.regexp_extract(x, rx(rf"\A{ORG}", "i"), 0)
        return let(first, lambda form: (form != "") & ~has(F.substring(x, F.length(form) + 1, F.lit(60)), BANK))

    return let(s, lambda x: F.when(begins(without_marks(x)), x).otherwise(cut(x)))


def party_lines(body: Column, most: int = 4) -> Column:
    """A party's first lines in one, up to a signature or a neighbouring field; NULL if there are none."""

    def cut(own: Column) -> Column:
        def beside(x: Column) -> Column:
            return F.coalesce(position(x, NEIGHBOUR) > 0, F.lit(False))

        stop = F.array_position(F.transform(own, lambda x: has(x, PARTY_END) | beside(x)), True).cast("int")

        def taken(n: Column) -> Column:
            at = F.get(own, n - 1)
            head = F.when((n > 0) & ~has(at, PARTY_END), strip(before(at, NEIGHBOUR), r" ,;:\-–—"))
            whole = F.when(n > 0, F.slice(own, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(own)
            return F.concat(whole, F.filter(F.array(head), lambda x: x.isNotNull() & (x != "")))

        return F.array_join(F.transform(F.slice(let(stop, taken), 1, most), lambda x: F.regexp_replace(x, ",+$", "")), ", ")

    return filled(let(meaningful_lines(body), cut))
