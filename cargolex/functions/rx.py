"""Regular expressions and slices with the semantics that the extraction rules are written in.

Every pattern gets Unicode classes and line ends at \\n alone; a match that is not there is NULL, not ''.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# private-use characters that part a text at matches
MARK, MARK_END = "\ue001", "\ue002"
SPACE = r"[\s\x1c-\x1f]"
#: What \s and the separators above are, as characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

_CLASS = re.compile(r"\\[sSwWdDbB]")
#: What stands for no letter by itself, so that a pattern of nothing else needs no look at cases.
_CASELESS = re.compile(r"\\x\{[0-9a-fA-F]+\}|\\x[0-9a-fA-F]{2}|\\[pP]\{[LN]\}|\\.|\(\?[a-z]+[:)]", re.S)


def rx(pattern: str, flags: str = "") -> str:
    """flags: i ignores case, m anchors at lines, s lets the dot match line ends."""
    if "i" in flags and not any(x.isalpha() for x in _CASELESS.sub("", pattern)):
        flags = flags.replace("i", "")
    return f"(?d{'U' if _CLASS.search(pattern) else ''}{flags}{'u' if 'i' in flags else ''}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(c: Column) -> Column:
    """NULL for what is empty. Not nullif(), which within a function of elements computes c twice, and twice again for each one around it."""
    return let(c, lambda x: F.when(x != "", x))


def has(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.coalesce(c.rlike(rx(pattern, flags)), F.lit(False))


def contains_any(c: Column, *texts: str) -> Column:
    found = c.contains(texts[0])
    for text in texts[1:]:
        found = found | c.contains(text)
    return found


def find(c: Column, pattern: str, group: int = 0, flags: str = "i") -> Column:
    """The first match, or a group of it; NULL if there is none or it is empty."""
    return filled(F.regexp_extract(c, rx(pattern, flags), group))


def find_all(c: Column, pattern: str, group: int = 0, flags: str = "i") -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, flags)), F.lit(group))


def replace(c: Column, pattern: str, by: str, flags: str = "i") -> Column:
    return F.regexp_replace(c, rx(pattern, flags), by)


def before(c: Column, pattern: str, flags: str = "i") -> Column:
    """What stands before the first match; all of it without one."""
    return F.regexp_replace(c, rx(f"(?:{pattern})(?s:.*)\\z", flags), "")


def position(c: Column, pattern: str, flags: str = "i") -> Column:
    """Characters before the first match; NULL without one."""
    return first_match(c, pattern, flags)["at"]


@lru_cache
def members(chars: str) -> str:
    """The characters of a regex class."""
    out: list[str] = []
    tokens = re.findall(r"\\x[0-9a-fA-F]{2}|\\.|.", chars, re.S)
    at = 0
    one = {r"\t": "\t", r"\n": "\n", r"\r": "\r"}
    char = lambda t: one.get(t) or (chr(int(t[2:], 16)) if t.startswith(r"\x") else t[-1])
    while at < len(tokens):
        if tokens[at] == r"\s":
            out.append(SPACES)
        elif tokens[at + 1 : at + 2] == ["-"] and at + 2 < len(tokens):
            out += map(chr, range(ord(char(tokens[at])), ord(char(tokens[at + 2])) + 1))
            at += 2
        else:
            out.append(char(tokens[at]))
        at += 1
    return "".join(out)


def strip(c: Column, chars: str = r"\s") -> Column:
    """White space, or the characters of a regex class, cut off both ends."""
    return F.btrim(c, F.lit(members(chars)))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def without_marks(c: Column, marks: str = MARK + MARK_END) -> Column:
    """c with the characters that mark matches replaced; a search for bytes tells whether there are any."""
    return let(c, lambda x: F.when(contains_any(x, *marks), F.translate(x, marks, "?" * len(marks))).otherwise(x))


def marked(c: Column, pattern: str, flags: str = "i") -> Column:
    """The text before the first match, and from each match up to the next one."""
    return F.split(F.regexp_replace(without_marks(c), rx(pattern, flags), MARK + "$0"), MARK, -1)


def matches(c: Column, pattern: str, flags: str = "i") -> Column:
    """Of each match: `at` (the characters before it) and `found` (its text). What lies around it is for the caller to cut out of c."""

    def placed(parts: Column) -> Column:
        own = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, MARK_END, 2))
        lengths = lambda pieces: F.transform(pieces, lambda p: F.length(F.get(p, F.lit(0))) + F.length(F.get(p, F.lit(1))))
        return let(own, lambda pieces: F.zip_with(starts(lengths(pieces), F.length(F.get(parts, F.lit(0)))), pieces, lambda at, p: F.struct(at.alias("at"), F.get(p, F.lit(0)).alias("found"))))

    return let(F.split(F.regexp_replace(without_marks(c), rx(pattern, flags), f"{MARK}$0{MARK_END}"), MARK, -1), placed)


#: Elements that a fold over an array of its own results takes at once: such a fold copies them at every step.
FOLD = 64


def starts(lengths: Column, first: Column) -> Column:
    """Where each of some pieces begins, the first at `first`: sums of blocks, then sums within each block, so no long array is copied again and again."""

    def running(own: Column, start: Column) -> Column:
        return F.aggregate(own, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def blocks(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(parts, F.slice(running(sums, first), F.lit(1), F.size(parts)), lambda p, start: F.slice(running(p, start), F.lit(1), F.size(p))))

    n = F.size(lengths)
    size = F.greatest(F.lit(FOLD), F.sqrt(n.cast("double")).cast("int"))
    many = let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, size)), blocks)
    return F.when(n > FOLD, many).otherwise(F.slice(running(lengths, first), F.lit(1), n))


def first_match(c: Column, pattern: str, flags: str = "i") -> Column:
    """`at` and `found` of the first match; NULL if there is none."""

    def placed(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.get(parts, F.lit(1)).alias("found")))

    return let(F.split(F.regexp_replace(without_marks(c), rx(f"({pattern})(?s:.*)\\z", flags), MARK + "$1"), MARK, 2), placed)


def behind(c: Column, m: Column, n: int) -> Column:
    """n characters behind a match."""
    return F.substring(c, m["at"] + F.length(m["found"]) + 1, F.lit(n))


def last_chars(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def first_of(items: Column, keep: Callable[[Column], Column]) -> Column:
    """The first element that meets a condition; NULL if none does."""
    return F.get(F.filter(items, keep), F.lit(0))
