"""Validators and finders: dates, vehicle plates, tax ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import find, find_all, first_of, has, let, replace, rx, strip

DATE = r"(?=[0-9])\b([0-9]{2}\.[0-9]{2}\.[0-9]{4})\b"
# Dates of decrees that are printed on the forms.
FORM_DATES = ["30.11.2021", "21.12.2020", "26.12.2011", "02.04.2021", "02.04.2024", "11.12.2023"]
# Letters of plates, and their Latin twins.
PLATE_LETTERS, PLATE_TWINS = "АВЕКМНОРСТУХ", "ABEKMHOPCTYX"
_ANY = f"[{PLATE_LETTERS}{PLATE_TWINS}]"
_PLATE = rf"(?:{_ANY}[0-9]{{3}}{_ANY}{{2}}\s?[0-9]{{2,3}}|{_ANY}{{2}}[0-9]{{4}}\s?[0-9]{{2,3}})(?![0-9])"
#: The same behind a look for its digits, which are rarer than its letters.
_SOUGHT_PLATE = rf"(?=[^0-9]{{1,2}}[0-9]{{3}}){_PLATE}"
_CAR = rf"([{PLATE_LETTERS}])([0-9]{{3}})([{PLATE_LETTERS}]{{2}})\s?([0-9]{{2,3}})"
_TRAILER = rf"([{PLATE_LETTERS}]{{2}})([0-9]{{4}})\s?([0-9]{{2,3}})"
# Weights of the check digits of tax ids.
WEIGHTS_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
WEIGHTS_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
WEIGHTS_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
TAX_ID = r"(?=[0-9])\b([0-9]{10}|[0-9]{12})\b"


def is_valid_date(c: Column, as_of_year: int) -> Column:
    """DD.MM.YYYY, on the calendar, ten years back to one ahead."""
    own = strip(c)
    year = F.right(own, F.lit(4)).try_cast("int")
    return F.coalesce(has(own, r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}\z", "") & year.between(as_of_year - 10, as_of_year + 1) & F.try_to_date(own, "dd.MM.yyyy").isNotNull(), F.lit(False))


def is_document_date(c: Column, as_of_year: int) -> Column:
    """A valid date that is not one of the form's own."""
    return is_valid_date(c, as_of_year) & ~c.isin(FORM_DATES)


def first_date(c: Column, as_of_year: int) -> Column:
    return first_of(find_all(c, DATE, 1), lambda x: is_document_date(x, as_of_year))


def cyrillic_plate(c: Column) -> Column:
    return F.translate(F.upper(c), PLATE_TWINS, PLATE_LETTERS)


def is_valid_plate(c: Column) -> Column:
    own = strip(F.replace(cyrillic_plate(c), F.lit("  "), F.lit(" ")))
    return has(own, rf"^(?:{_CAR}|{_TRAILER})$", "")


def find_plate(c: Column) -> Column:
    """The first candidate in a text, in Cyrillic letters; NULL if there is none."""
    return _first_plate(F.upper(c))


def _first_plate(upper: Column) -> Column:
    return strip(cyrillic_plate(find(upper, _SOUGHT_PLATE, 0, "")))


def format_plate(c: Column) -> Column:
    """With spaces between its parts; what is no plate stays."""
    own = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    return F.when(has(own, f"^{_CAR}$", ""), replace(own, f"^{_CAR}$", "$1 $2 $3 $4", "")).when(has(own, f"^{_TRAILER}$", ""), replace(own, f"^{_TRAILER}$", "$1 $2 $3", "")).otherwise(c)


def compact_plate(c: Column) -> Column:
    """A plate whose parts may be spaced out; only the first candidate counts."""
    joined = F.regexp_replace(F.upper(c), rx(r"\s(?<=[А-ЯЁA-Z0-9]\s)\s*(?=[А-ЯЁA-Z0-9])"), "")
    return let(_first_plate(joined), lambda p: F.when(is_valid_plate(p), F.replace(p, F.lit(" "), F.lit(""))))


def _check_digit(digits: Column, weights: list[int]) -> Column:
    weighted = F.zip_with(F.slice(digits, 1, len(weights)), F.array(*map(F.lit, weights)), lambda d, w: d * w)
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11 % 10 == F.get(digits, F.lit(len(weights)))


def is_valid_tax_id(c: Column) -> Column:
    """Ten or twelve digits whose check digits hold."""

    def holds(d: Column) -> Column:
        return F.when(F.size(d) == 10, _check_digit(d, WEIGHTS_10)).otherwise(_check_digit(d, WEIGHTS_11) & _check_digit(d, WEIGHTS_12))

    digits = F.transform(F.split(c, ""), lambda x: x.try_cast("int"))
    return F.coalesce(F.when(has(c, r"^(?:[0-9]{10}|[0-9]{12})\z", ""), let(digits, holds)), F.lit(False))


def first_tax_id(c: Column) -> Column:
    return first_of(find_all(c, TAX_ID, 1), is_valid_tax_id)
