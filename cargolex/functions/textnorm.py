"""Normalisation of OCR text, and what marks a token, a line or a value as garbage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GARBAGE, MISSING
from .rx import MARK, MARK_END, SPACE, contains_any, filled, find_all, has, let, replace, strip

# Invisible characters, dashes, and Latin letters with their Cyrillic look-alikes.
INVISIBLE = "­​‌‍﻿‪‬"
DASHES = "-‐‑‒–—―−"
LATIN, CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"
QUOTES = "\"'`‘’‚‛“”„‟"
#: What surrounds a token and is not part of it, as a regex class.
AROUND = r"\s.,;:!?\"'«»()\[\]{}|\\/=_~\^`<>*#$%+‐-―‘’“”"
# Letters that Russian forms never have.
FOREIGN = "іїєґІЇЄҐ" + "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸÑÇ"

_CYR, _ALL = "А-Яа-яЁё", "А-Яа-яЁёA-Za-z"
_DASH = DASHES.replace("-", "\\-")
_WORD = r"[^\s\x1c-\x1f]+"


# Each step stands behind a test that costs less than the step and tells whether it can change anything: a search for bytes, or a scan for one class.


def _only(c: Column, may: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    return let(c, lambda x: F.when(may(x), change(x)).otherwise(x))


def strip_invisible(c: Column) -> Column:
    return _only(c, lambda x: contains_any(x, *INVISIBLE), lambda x: F.regexp_replace(x, f"[{INVISIBLE}]", ""))


def join_hyphen_breaks(c: Column) -> Column:
    """Words parted by a dash at a line end become one. A letter that ends one break begins no other (\\G)."""
    broken = rf"[{_DASH}](?<=[{_ALL}](?!\G).){SPACE}*\n{SPACE}*([{_ALL}])"
    return _only(c, lambda x: has(x, rf"[\-‐-―−]{SPACE}*\n", ""), lambda x: replace(x, broken, "$1", ""))


def collapse_spaces(c: Column) -> Column:
    """Runs of horizontal spaces become one space, runs of line ends one line end."""
    spaced = _only(c, lambda x: contains_any(x, "  ", "\t", "\xa0", "\u2009", "\u202f"), lambda x: replace(x, r"[ \t\xa0\x{2009}\x{202f}]+", " "))
    return _only(spaced, lambda x: x.contains("\n\n"), lambda x: replace(x, "\n{2,}", "\n"))


def fix_lookalikes(c: Column) -> Column:
    """Latin look-alikes beside Cyrillic letters of their word become Cyrillic; a run of them after a Cyrillic letter as a whole."""
    # a Latin letter is looked for first, and what stands beside it only there
    beside = rf"[{LATIN}](?:(?<=[{_CYR}].)[{LATIN}]*|(?=[{_CYR}]))"

    def fixed(part: Column, i: Column) -> Column:
        own = F.split(part, MARK_END, 2)
        return F.when(i == 0, part).otherwise(F.concat(F.translate(F.get(own, F.lit(0)), LATIN, CYRILLIC), F.get(own, F.lit(1))))

    unmarked = _only(c, lambda x: contains_any(x, MARK, MARK_END), lambda x: F.translate(x, MARK + MARK_END, ""))
    return _only(unmarked, lambda x: has(x, f"[{LATIN}]", ""), lambda x: F.array_join(F.transform(F.split(replace(x, beside, f"{MARK}$0{MARK_END}", ""), MARK, -1), fixed), ""))


#: A text that no step of normalize changes: words and runs of signs, each with the space or line end behind it (single ranges and Latin-1 sets, which
#: are looked up at once), then what may stand alone, then all but what a step looks for.
_STEADY = rf"\A(?:[А-я]+[ \n]?|[0123456789.,:;()«»]+[ \n]?|(?<! ) |(?<!\n)\n|[{_DASH}](?!{SPACE}*\n)|[^{LATIN}{INVISIBLE}{_DASH}{MARK}{MARK_END} \t\n\r\xa0\x{{2009}}\x{{202f}}])*+\z"


def normalize(c: Column) -> Column:
    """All of the above in their order, with CR and CRLF as line ends and the ends stripped. One scan tells whether any of them can change the text."""

    def steps(x: Column) -> Column:
        t = _only(strip_invisible(x), lambda y: y.contains("\r"), lambda y: F.replace(F.replace(y, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
        return fix_lookalikes(collapse_spaces(join_hyphen_breaks(t)))

    return strip(_only(c, lambda x: ~has(x, _STEADY, ""), steps))


def single_line(c: Column) -> Column:
    return strip(replace(replace(c, "\n+", " "), r"[ \t\xa0\x{2009}\x{202f}]+", " "))


def is_garbage(c: Column) -> Column:
    """No Cyrillic or Latin letter and no digit; NULL is garbage too."""
    return ~has(c, rf"[{_ALL}0-9]", "")


def script_runs(c: Column) -> Column:
    """How many times a word changes between Cyrillic and Latin, plus one; other characters do not count."""
    letters = F.regexp_replace(c, f"[^{_ALL}]", "")
    return F.length(F.regexp_replace(F.regexp_replace(letters, f"[{_CYR}]+", "1"), "[A-Za-z]+", "2"))


def is_garbage_token(token: Column) -> Column:
    """Whether a token is what OCR makes of stains and broken words."""
    core = strip(token, AROUND)
    quotes = f"[{QUOTES}]"

    def judged(core: Column) -> Column:
        return (
            F.when(token == "", True)
            .when(has(token, rf"[{_ALL}0-9]{quotes}+[{_ALL}]", ""), True)
            .when(has(token, r"[0-9][\"'`‘’]+$", ""), True)
            .when(core == "", F.array_size(F.array_distinct(F.split(token, ""))) >= 2)
            .when(has(core, f"[{FOREIGN}]", ""), True)
            .when(has(core, rf"[{_ALL}0-9]{quotes}+[{_ALL}]", ""), True)
            .when(has(core, rf"[{_ALL}0-9][\"'`‘’‚‛“”]+$", ""), True)
            .otherwise(script_runs(core) >= 3)
        )

    return F.coalesce(let(core, judged), F.lit(True))


_WITHIN = rf"[^\s\x1c-\x1f{_ALL}]*"
_SUSPECT = rf"[{QUOTES}{FOREIGN}]|[{_CYR}]{_WITHIN}[A-Za-z]|[A-Za-z]{_WITHIN}[{_CYR}]|(?<![^\s\x1c-\x1f])[{AROUND}&&[^\s\x1c-\x1f]]{{2,}}(?![^\s\x1c-\x1f])"


#: A line of Cyrillic words, numbers, single spaces and signs none of which stand alone in twos: no token of it can be garbage, nothing in it is doubled.
_PURE = r"\A(?:(?:[А-я]+|[0123456789]+)[.,:;()«»№—\-]*| (?! )|[.,:;()«»№—\-](?![.,:;()«»№—\-])|[Ёё³])*+\z"


def is_pure(c: Column) -> Column:
    return has(c, _PURE, "")


def may_have_garbage(c: Column) -> Column:
    """False where no token can be garbage: no quote, no foreign letter, no word of two scripts and no run of signs alone. One scan instead
    of a judgement of each token; what it lets through is judged token by token."""
    return ~is_pure(c) & has(c, _SUSPECT, "")


def tokens(c: Column) -> Column:
    return find_all(c, _WORD, 0, "")


def noise_share(line: Column) -> Column:
    """Share of garbage among the tokens of a line; 1 for a blank one."""

    def share(own: Column) -> Column:
        return F.when(F.size(own) > 0, F.size(F.filter(own, is_garbage_token)) / F.size(own)).otherwise(1.0)

    def judged(x: Column) -> Column:
        clean = F.when(has(x, r"[^\s\x1c-\x1f]", ""), 0.0).otherwise(1.0)
        return F.when(may_have_garbage(x), let(tokens(x), share)).otherwise(clean)

    return F.coalesce(let(line, judged), F.lit(1.0))


def is_noise_line(line: Column, ratio: float = 0.5) -> Column:
    return noise_share(line) >= ratio


def strip_garbage_tokens(c: Column) -> Column:
    """Garbage tokens dropped, the white space around them kept, runs of it then one space."""

    def kept(x: Column) -> Column:
        own = F.filter(find_all(x, f"{_WORD}|{SPACE}+", 0, ""), lambda t: has(t, rf"^{SPACE}*$", "") | ~is_garbage_token(t))
        return F.when(has(x, _SUSPECT, ""), F.array_join(own, "")).otherwise(x)

    return let(c, lambda x: F.when(is_pure(x), strip(x)).otherwise(strip(replace(kept(x), rf"{SPACE}{{2,}}", " "))))


def clean_line(c: Column) -> Column:
    """strip_garbage_tokens of a line that is not noise, NULL for one that is; what may have garbage is looked for once."""

    def dirty(x: Column) -> Column:
        return F.when(~is_noise_line(x), strip_garbage_tokens(x))

    clean = lambda x: F.when(has(x, r"[^\s\x1c-\x1f]", ""), strip(replace(x, rf"{SPACE}{{2,}}", " ")))
    return let(c, lambda x: F.when(is_pure(x), filled(strip(x))).when(has(x, _SUSPECT, ""), dirty(x)).otherwise(clean(x)))


def clean_value(c: Column) -> Column:
    """A value without the separators around it; the sentinel for what is empty or garbage."""

    def judged(own: Column) -> Column:
        return F.when(F.coalesce(own, F.lit("")) == "", MISSING).when(is_garbage(own), GARBAGE).otherwise(own)

    return F.coalesce(let(strip(c, r"\s:;,.\-–—|"), judged), F.lit(MISSING))
