"""Similarity of short strings: the normalised insert-and-delete ratio, and its best value over windows of the longer string.

For section titles it is an expression: a name's characters are bits of a BIGINT, and the longest common subsequence is folded over the title a
character at a time. `fuzzy_role` says the same in Python, for tests.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import SPACES

# Titles of sections by role, more specific ones first; the least score and the least lead over the next role.
ROLE_TITLES = [
    ("reception", ["прием груза", "приём груза", "погрузка груза"]),
    ("consignee", ["грузополучатель", "покупатель"]),
    ("shipper", ["грузоотправитель", "продавец", "поставщик"]),
    ("vehicle", ["транспортное средство"]),
    ("carrier", ["перевозчик"]),
    ("cargo", ["груз"]),
]
#: What a misread title is compared with: "груз" alone begins three of them.
TITLES = ROLE_TITLES[:-1]
ACCEPT, LEAD, LEAST_WORD, WINDOW = 82.0, 6.0, 5, 40
_ENDS_WORD = " \t\n\r\f\v:.,–—-"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one integer for each character of a."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length in the longer one, windows over the ends included; of strings of
    one length each is tried as the shorter."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = max(ratio(short, long[max(i, 0) : i + n]) for i in range(1 - n, len(long)))
    return best if n < len(long) else max(best, *(ratio(long, short[max(i, 0) : i + n]) for i in range(1 - n, n)))


@lru_cache(100_000)
def fuzzy_role(title: str) -> str | None:
    low = title.strip().lower()
    word = low
    for ch in _ENDS_WORD:
        word = word.split(ch, 1)[0]
    if len(word) < LEAST_WORD:
        return None
    scores = sorted(((max(max(ratio(word, n.split()[0]), partial_ratio(low[:WINDOW], n)) for n in names), role) for role, names in TITLES), reverse=True)
    return scores[0][1] if scores[0][0] >= ACCEPT and scores[0][0] - scores[1][0] >= LEAD else None


_STEP = "(r, m) -> ((r + (r & m)) | (r - (r & m)))"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _bits(text: str, name: str) -> str:
    """Of each character of a text, the places where a name has it."""
    where: dict[str, int] = {}
    for i, ch in enumerate(name):
        where[ch] = where.get(ch, 0) | 1 << i
    return f"transform(split({text}, ''), c -> coalesce(try_element_at(map({', '.join(f"'{ch}', {m}L" for ch, m in where.items())}), c), 0L))"


def _whole(word: str, name: str) -> str:
    """Ratio of a word and a name."""
    n = len(name)
    full = (1 << n) - 1
    return f"200D * ({n} - bit_count(aggregate({_bits(word, name)}, {full}L, {_STEP} & {full}L))) / ({n} + length({word}))"


def _window(text: str, name: str) -> str:
    """The best ratio of the shorter of both with a window of the longer one, as partial_ratio."""
    n = len(name)
    full = (1 << n) - 1
    inside = f"transform(sequence({1 - n}, length({text}) - 1), i -> {_let('w', 'slice(b, greatest(i, 0) + 1, least(i + ' + str(n) + f', length({text})) - greatest(i, 0))', f'200D * ({n} - bit_count(aggregate(w, {full}L, {_STEP} & {full}L))) / ({n} + size(w))')})"
    size = f"least(i + length({text}), {n}) - greatest(i, 0)"
    around = f"transform(sequence(1 - length({text}), {n - 1}), i -> {_let('w', size, f'200D * (w - bit_count(aggregate(transform(b, x -> shiftright(x, greatest(i, 0)) & (shiftleft(1L, w) - 1)), shiftleft(1L, w) - 1, {_STEP} & (shiftleft(1L, w) - 1)))) / (length({text}) + w)')})"
    # no window has more in common than the whole text, and what stays this low can neither win nor be in the winner's way
    bound = f"200D * c / (least({n}, length({text})) + c) < {ACCEPT - LEAD}D"
    common = f"{n} - bit_count(aggregate(b, {full}L, {_STEP} & {full}L))"
    return _let("b", _bits(text, name), _let("c", common, f"if({bound}, 0D, array_max(concat(if(length({text}) >= {n}, {inside}, array()), if(length({text}) <= {n}, {around}, array()))))"))


_NAMES = [n for _, names in TITLES for n in names]


def _letters(text: str) -> str:
    """Of each character of a text, the places where each of the names has it: one look for all names."""
    where = {ch: [sum(1 << i for i, x in enumerate(n) if x == ch) for n in _NAMES] for ch in dict.fromkeys("".join(_NAMES))}
    own = ", ".join(f"'{ch}', array({', '.join(f'{m}L' for m in masks)})" for ch, masks in where.items())
    return f"transform(split({text}, ''), c -> coalesce(try_element_at(map({own}), c), array({', '.join(['0L'] * len(_NAMES))})))"


def _common(letters: str, k: int, n: int) -> str:
    """Length of the longest common subsequence of a text, by its _letters, and the first n characters of a name."""
    full = (1 << n) - 1
    return f"({n} - bit_count(aggregate({letters}, {full}L, {_STEP.replace('& m', f'& m[{k}]')} & {full}L)))"


def _surely(otherwise: str) -> str:
    """The role if the scores of whole words and the bounds of all others decide it, so that no window has to be looked at. No score of a title with
    a name exceeds its bound: no window of `low` has more in common than all of it."""

    def judged(k: int, name: str) -> str:
        first, n = len(name.split()[0]), len(name)
        of_low = _common("b", k, n) if first < n else f"if(low = word, x, {_common('b', k, n)})"
        return _let("x", _common("a", k, first), _let("y", of_low, f"struct(200D * x / ({first} + length(word)) as s, 200D * y / (least({n}, length(low)) + y) as u)"))

    def role_scores(role: str, names: list[str]) -> str:
        own = "array(" + ", ".join(judged(_NAMES.index(n), n) for n in names) + ")"
        return _let("o", own, f"struct(array_max(o.s) as s, greatest(array_max(o.s), array_max(o.u)) as u, '{role}' as role)")

    quick = "array(" + ", ".join(role_scores(role, names) for role, names in TITLES) + ")"
    clear = f"filter(q, x -> x.s >= {ACCEPT}D and forall(q, y -> y.role = x.role or x.s - y.u >= {LEAD}D))"
    decided = _let("q", quick, _let("clear", clear, f"case when size(clear) > 0 then clear[0].role when forall(q, x -> x.u < {ACCEPT}D) then null else {otherwise} end"))
    return _let("a", _letters("word"), _let("b", f"if(low = word, a, {_letters('low')})", decided))


def fuzzy_roles(titles: str) -> Column:
    """Roles of a column of arrays of titles that no exact rule knows: the best by far, or NULL. One expression, parsed at once."""
    score = lambda names: "greatest(" + ", ".join(x for n in names for x in (_whole("word", n.split()[0]), _window("low", n))) + ")"
    scores = "array(" + ", ".join(f"struct({score(names)} as s, '{role}' as role)" for role, names in TITLES) + ")"
    best = _let("o", f"reverse(array_sort({scores}))", f"if(o[0].s >= {ACCEPT}D and o[0].s - o[1].s >= {LEAD}D, o[0].role, null)")
    judged = f"if(length(word) < {LEAST_WORD}, null, {_let('low', f'left(title, {WINDOW})', _surely(best))})"
    ends = _ENDS_WORD.replace("-", r"\\-")
    words = _let("word", f"split(title, '[{ends}]', 2)[0]", judged)
    return F.expr(f"transform({titles}, t -> {_let('title', f"lower(btrim(t, '{SPACES}'))", words)})")


def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)])


def partial_similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_partial, "double")(a, b)
