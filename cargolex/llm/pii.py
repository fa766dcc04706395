"""PII by offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then a chain of transducers rewrites it: homoglyphs and
foreign digits to ASCII, invisible characters to nothing, spelled digits to digits, at and dot disguises to @ and full stops. Each
character of the rewritten text keeps the source characters that it stands for, so what is detected there is mapped back to a span
of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ["email", "ip", "card", "phone"]

# Characters that look like ASCII ones, and what they look like.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν" + "․。·﹫" + "‐‑‒–—−" + "\u00a0\u2009\u202f\u3000",
        "ABEKMHOPCTYXIJSaeopcyxijsdh" + "ABEZHIKMNOPTYXoav" + "...@" + "------" + "    ",
        strict=True,
    )
)
#: Invisible characters.
_INVISIBLE = "­​‌‍⁠﻿"
#: Names of the digits 0 to 9 in English, German, French and Spanish, and of plus.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = r"(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + r")"
#: A name of a digit that stands alone; its first letter lets the scan skip most words.
_NUMBER = re.compile(rf"(?=[zontfseuhdqcpva])(?<![^\W_]){_WORD}(?![^\W_])", re.I)
#: Up to so many of these characters may stand between a name of a digit and what it touches; those of _MERGED fall away between names.
_GAP, _NEAR, _MERGED = 3, frozenset(" ,;().-"), frozenset(" ,;-")
#: What re.I takes for an i, too.
_TURKISH = {0x130: "i", 0x131: "i"}
_DIGIT = frozenset("0123456789+")
_BRACKETED = r"[ ]?[\[({<][ ]?(?:%s)[ ]?[\])}>][ ]?"
_DOTS = _BRACKETED % "dot|[.]|punkt|point|punto" + "| dot (?=[A-Za-z0-9])"
#: A host of "name at host": it has a disguised dot, or its ending is in one case or well known (not "at noon.Then", "at e.g." or "at 3.5").
_HOST = rf"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*?(?:{_DOTS}|\.(?:(?-i:[a-z]{{2,}}|[A-Z]{{2,}})|xn--[a-z0-9-]+|com|org|net|edu|gov|info|io|uk)(?![A-Za-z0-9-]|\.[A-Za-z0-9-]))"
_AT = re.compile(_BRACKETED % "at|@|arroba" + rf"|(?<=[A-Za-z0-9]) at (?={_HOST})", re.I)
_DOT = re.compile(_BRACKETED % "dot|[.]|punkt|point|punto" + "|(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)


def _folds() -> dict[str, str]:
    """What each foldable character becomes: digits of any script, letters that NFKC makes ASCII, look-alikes; invisible ones nothing."""
    out = {}
    # no foldable character is among the ideographs and syllables left out
    for c in map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]):
        d, n = unicodedata.decimal(c, None), unicodedata.normalize("NFKC", c)
        if d is not None:
            out[c] = str(d)
        elif n.isascii() and n.isalpha() and (len(n) == 1 or c.isalpha()):
            out[c] = n
    out |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return out | _LOOKALIKES | dict.fromkeys(_INVISIBLE, "")


_FOLDS = _folds()
#: All foldable characters, and others beyond the first plane, where a set of many characters would be searched one by one.
_FOLDABLE = re.compile("[" + "".join(re.escape(c) for c in _FOLDS if c < "\U00010000") + "\U00010000-\U0001ffff]")


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str):
    """Each @ in turn, with the longest run of name characters before it that no earlier match has taken."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers in a text as it is; leftmost and non-overlapping for each kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text and, for each of its characters, the source characters from `low` to `high` (exclusive) it stands for."""

    def __init__(self, text: str):
        self.text, self.low, self.high = text, range(len(text)), range(1, len(text) + 1)

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Characters a to b become s; each character of s stands for all of them."""
        if not edits:
            return self
        parts, low, high, at = [], [], [], 0
        for a, b, s in edits:
            parts += [self.text[at:a], s]
            low += [*self.low[at:a], *[self.low[a]] * len(s)]
            high += [*self.high[at:a], *[self.high[b - 1]] * len(s)]
            at = b
        out = Rewritten("".join(parts) + self.text[at:])
        out.low, out.high = [*low, *self.low[at:]], [*high, *self.high[at:]]
        return out


def _spelled(text: str):
    """Names of digits that touch a digit, a plus or another name; what is between two names goes, between a name and a digit it is one character.

    A full stop and a space part sentences, and a name with a capital alone after a digit begins one.
    """
    names = [(m.start(), m.end(), _SPELLED[m[0].translate(_TURKISH).lower()]) for m in _NUMBER.finditer(text)]
    for i, (a, b, digit) in enumerate(names):
        low, high = a, b
        while low > 0 and a - low < _GAP and text[low - 1] in _NEAR:
            low -= 1
        while high < len(text) and high - b < _GAP and text[high] in _NEAR:
            high += 1
        whole, ended = ". " not in text[low:a], ". " in text[b:high]
        named = whole and i > 0 and names[i - 1][1] >= low
        after = not ended and high < len(text) and text[high] in _DIGIT
        more = after or not ended and i + 1 < len(names) and names[i + 1][0] <= high
        before = whole and low > 0 and text[low - 1] in _DIGIT and (named or more or not text[a:b].istitle())
        if not (named or before or more):
            continue
        if low < a and _MERGED.issuperset(text[low:a]) and (named or before and text[low:a] not in " -"):
            yield low, a, "" if named else " "
        yield a, b, digit
        if b < high and after and _MERGED.issuperset(text[b:high]) and text[b:high] not in " -":
            yield b, high, " "


def rewrite(text: str) -> Rewritten:
    r = Rewritten(text)
    r = r.replaced([(m.start(), m.end(), _FOLDS[m[0]]) for m in _FOLDABLE.finditer(r.text) if m[0] in _FOLDS])
    r = r.replaced([(m.start(), m.end(), "@") for m in _AT.finditer(r.text)])
    r = r.replaced([(m.start(), m.end(), ".") for m in _DOT.finditer(r.text)])
    return r.replaced(list(_spelled(r.text)))


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans of the source: identifiers of the rewritten text that are not there as they are and that no plain one of their kind covers."""
    r = rewrite(text)
    if r.text == text:
        return []
    starts, ends = [[] for _ in KINDS], [[] for _ in KINDS]
    for a, kind, b in base:
        starts[kind].append(a)
        ends[kind].append(b)
    out = []
    for a, kind, b in plain(r.text):
        low, high = r.low[a], r.high[b - 1]
        # plain spans of a kind do not overlap: the last that starts by low is the only one that can cover
        last = bisect_right(starts[kind], low) - 1
        if text[low:high] != r.text[a:b] and (last < 0 or ends[kind][last] < high):
            out.append((low, kind, high))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches):
    for batch in batches:
        counts, shas, spans, added = [[] for _ in KINDS], [], [], []
        for text in batch.column(1).to_pylist():
            base = plain(text or "")
            more = disguised(text or "", base)
            for k, own in enumerate(counts):
                own.append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(_written(base).encode()).hexdigest())
            spans.append(_written(sorted({*base, *more})))
            added.append(len(more))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256, spans (all), n_disguised.

    Offsets are code points, ends exclusive. A null text is empty; texts of any length are read in one pass; repeated rows are found alike; an
    empty table gives an empty one; other columns are not looked at.
    """
    return texts(docs).mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
