"""Sections of a waybill: header candidates, their roles, and the text between them.

Titles known by an exact rule are classified by expressions; only titles that no rule knows go to the fuzzy scorer, an expression too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ROLE_TITLES, fuzzy_roles
from ..functions.rx import MARK, filled, first_of, has, let, rx, starts, strip, without_marks
from ..schema import ROLES

IGNORED = "__ignored__"
# Titles that only end a section; roles by number on the form of 2022.
STOP_TITLES = ["сопроводительные документы", "указания грузоотправителя", "условия перевозки", "информация о принятии", "оговорки и замечания", "прочие условия", "переадресовк", "стоимость услуг", "стоимость перевозки", "дата составления", "отметки", "выдача груза", "сдача груза"]
ROLE_BY_NUMBER = {"3": "cargo", "6": "carrier", "7": "vehicle", "8": "reception"}
_TITLES = [t for _, titles in ROLE_TITLES for t in titles] + STOP_TITLES
#: The known titles, by their first letters so that a line is compared only with those that begin like it.
_KNOWN = "|".join(f"{a}(?:{'|'.join(t[1:] for t in _TITLES if t[0] == a)})" for a in dict.fromkeys(t[0] for t in _TITLES))
NUMBERED = r"\s*([0-9]{1,2})\s*[.)\xa0]\s*([А-ЯЁа-яёA-Za-z][^\n]{0,80})"
NUMBERED_KNOWN = rf"\s*([0-9]{{1,2}})\s+((?:{_KNOWN}))\b[^\n]{{0,80}}$"
BARE_KNOWN = rf"\s*((?:{_KNOWN}))\b[^\n]{{0,80}}$"
# How OCR misreads the two long titles that begin like "груз".
MISREAD_CONSIGNEE, MISREAD_SHIPPER = r"^[ово]{0,2}(?:получ|пелуч|палуч|опуч)", r"^[ов]{0,2}(?:отправ|тправ|втир|стправ|тир|тпр)"


def exact_role(title: Column) -> Column:
    """The role of a title by its beginning; '?' if only the fuzzy scorer can tell, '?груз' if it may only tell the two that begin like "груз"."""

    def ruled(low: Column) -> Column:
        rule = F.when(F.exists(F.array(*map(F.lit, STOP_TITLES)), lambda t: F.startswith(low, t)), IGNORED)
        for role, titles in ROLE_TITLES:
            if role != "cargo":
                for t in titles:
                    rule = rule.when(F.startswith(low, F.lit(t)), role)
        rest = F.substring(low, F.lit(5), F.length(low))
        rule = rule.when(F.startswith(low, F.lit("груз")) & ((rest == "") | has(rest, r"^[ :.,\-–—\t]", "")), "cargo")
        rule = rule.when(F.startswith(low, F.lit("груз")) & has(rest, MISREAD_CONSIGNEE, ""), "consignee").when(F.startswith(low, F.lit("груз")) & has(rest, MISREAD_SHIPPER, ""), "shipper")
        return rule.when(F.startswith(low, F.lit("груз")), "?груз").otherwise("?")

    return let(strip(F.lower(title)), ruled)


def _either_case(text: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in text)


def _roles_group() -> str:
    """A group for each of RULED that takes part if the title that begins here is of that role, as exact_role says. The last alternative of the role
    "cargo" is a title of nothing but white space behind the word, as long as a title can be."""
    blank = r"(?:[^\S\n]|[\x1c-\x1f])"
    low = {role: titles for role, titles in ROLE_TITLES if role != "cargo"} | {IGNORED: STOP_TITLES, "?груз": ["груз"]}
    own = {role: [_either_case(t) for t in titles] for role, titles in low.items()}
    word = _either_case("груз")
    own["consignee"].append(word + _either_case(MISREAD_CONSIGNEE[1:]))
    own["shipper"].append(word + _either_case(MISREAD_SHIPPER[1:]))
    own["cargo"] = [word + rf"(?=[ :.,\-–—\t]|{blank}{{77}}|{blank}*(?:\n|\z))"]
    return "(?=(?:" + "|".join(f"({'|'.join(own[role])})" for role in RULED) + ")?)"


#: Roles that a title's beginning decides, in the order in which they are tried.
RULED = [IGNORED, "reception", "consignee", "shipper", "vehicle", "carrier", "cargo", "?груз"]
#: One alternation for the three ways to write a heading, tried at the beginnings of lines; the groups that took part tell which it was and, of
#: numbered titles, which role theirs is. A line is tried only as what its first character allows: no number begins with a letter, and the known
#: titles begin with letters from "в" to "у".
HEADER = rf"(?m:^)(?:(?=[^А-я])(?:{NUMBERED.replace('([А-', _roles_group() + '([А-')}|(?im:{NUMBERED_KNOWN}))|(?im:(?=[\sв-у]){BARE_KNOWN}))"
_SEP = "\ue003"
_N = len(RULED)
#: What a heading is replaced by: its number, its title in the group of its way, the groups of the roles, and itself.
_TOLD = _SEP.join(["$1", f"${_N + 2}", f"${_N + 4}", f"${_N + 5}", *(f"${i + 2}" for i in range(_N)), "$0"])


def pieces_of(text: Column) -> Column:
    """The text cut at its headings, by one scan: `head` is what stands before the first, and each of `parts` has its heading and what follows up
    to the next (text), the title, the role by an exact rule, by_number (the role of the section's number, for numbered titles) and rank
    (1 numbered, 2 numbered with a known title, 3 known title alone)."""

    def part(p: Column) -> Column:
        def parted(own: Column) -> Column:
            number, numbered, known, bare = (F.get(own, F.lit(i)) for i in range(4))
            by_number = F.when(numbered != "", F.when(number == "3", "cargo").when(number == "6", "carrier").when(number == "7", "vehicle").when(number == "8", "reception"))
            rank = F.when(numbered != "", 1).when(known != "", 2).otherwise(3)
            role = F.when(numbered == "", exact_role(F.concat(known, bare)))
            for i in range(_N):
                role = role.when(F.get(own, F.lit(4 + i)) != "", RULED[i])
            return F.struct(F.get(own, F.lit(4 + _N)).alias("text"), F.concat(numbered, known, bare).alias("title"), role.otherwise("?").alias("role"), by_number.alias("by_number"), rank.alias("rank"))

        return let(F.split(p, _SEP, 5 + _N), parted)

    def cut(parts: Column) -> Column:
        return F.struct(F.get(parts, F.lit(0)).alias("head"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), part).alias("parts"))

    return let(F.split(F.regexp_replace(without_marks(text, MARK + _SEP), rx(HEADER), MARK + _TOLD), MARK, -1), cut)


def _positions(pieces: Column) -> Column:
    return starts(F.transform(pieces["parts"], lambda p: F.length(p["text"])), F.length(pieces["head"]))


def header_candidates(text: Column) -> Column:
    """All header candidates in order: pos, rank, title, role by an exact rule, by_number."""
    return let(pieces_of(text), lambda own: F.zip_with(_positions(own), own["parts"], lambda at, p: F.struct(at.alias("pos"), p["rank"].alias("rank"), p["title"].alias("title"), p["role"].alias("role"), p["by_number"].alias("by_number"))))


def _decided(c: Column, fuzzy: Column) -> Column:
    """The role of a candidate: the exact one, else the fuzzy one (a map by title), else the number's; NULL if it is no heading."""
    guess = F.try_element_at(fuzzy, c["title"])
    guess = F.when((c["role"] == "?") | guess.isin("shipper", "consignee"), guess)
    return F.when(~c["role"].startswith("?"), c["role"]).otherwise(F.coalesce(guess, c["by_number"]))


def bounds_of(pieces: Column, fuzzy: Column) -> Column:
    """Of the pieces that begin a section: i (from 1) and role. Each role counts once, titles that only end a section always."""

    def kept(roles: Column) -> Column:
        numbered = F.transform(roles, lambda r, i: F.struct((i + 1).alias("i"), r.alias("role")))
        return F.filter(numbered, lambda x: (x["role"] == IGNORED) | (F.array_position(roles, x["role"]) == x["i"]))

    return let(F.transform(pieces["parts"], lambda p: _decided(p, fuzzy)), kept)


def _body(chunk: Column) -> Column:
    """What stands behind the first colon or dash of the heading line, and the lines below it."""

    def parted(own: Column) -> Column:
        top = F.get(own, F.lit(0))
        rest = strip(F.coalesce(F.get(own, F.lit(1)), F.lit("")))
        inline = strip(F.coalesce(F.get(F.split(top, r"[:\-–—]", 2), F.lit(1)), F.lit("")))
        return F.array_join(F.filter(F.array(inline, rest), lambda x: x != ""), "\n")

    return let(F.split(strip(chunk), "\n", 2), parted)


def unknown_titles(pieces: Column) -> Column:
    """The titles that only the fuzzy scorer can tell, each once."""
    return F.array_distinct(F.transform(F.filter(pieces["parts"], lambda c: c["role"].startswith("?")), lambda c: c["title"]))


def with_fuzzy_roles(rows: DataFrame, titles: Column) -> DataFrame:
    """Adds _fuzzy: the roles of an array of titles, by title."""
    own = rows.withColumn("_titles", titles)
    return own.withColumn("_roles", fuzzy_roles("_titles")).withColumn("_fuzzy", F.map_from_arrays("_titles", "_roles")).drop("_titles", "_roles")


def _with_pieces(docs: DataFrame, text: str) -> DataFrame:
    own = docs.withColumn("_pieces", pieces_of(F.col(text)))
    return with_fuzzy_roles(own, unknown_titles(F.col("_pieces")))


def add_markers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds markers: the (pos, role) that bound sections, in order."""
    placed = lambda at: F.transform(bounds_of(F.col("_pieces"), F.col("_fuzzy")), lambda b: F.struct(F.get(at, b["i"] - 1).alias("pos"), b["role"].alias("role")))
    return _with_pieces(docs, text).withColumn("markers", let(_positions(F.col("_pieces")), placed)).drop("_pieces", "_fuzzy")


def sections_of(pieces: Column, bounds: Column, wanted: list[str] = ROLES) -> Column:
    """A struct of the wanted roles' bodies, NULL where a role is absent. A section's text is its pieces joined, so that no text is cut by counting
    its characters; sections that nobody wants are not joined."""
    joined = lambda start, n: F.array_join(F.slice(pieces["parts"], start, n)["text"], "")

    def of(b: Column) -> Column:
        def body(role: str) -> Column:
            def between(at: Column) -> Column:
                start = F.get(b, at - 1)["i"]
                return F.when(at > 0, _body(joined(start, F.coalesce(F.get(b, at)["i"], F.size(pieces["parts"]) + 1) - start)))

            return let(F.array_position(b["role"], F.lit(role)).cast("int"), between)

        head = F.concat(pieces["head"], joined(F.lit(1), F.coalesce(F.get(b, F.lit(0))["i"] - 1, F.size(pieces["parts"]))))
        return F.struct(*((filled(strip(head)) if role == "head" else body(role)).alias(role) for role in wanted))

    return let(bounds, of)


def add_sections(docs: DataFrame, text: str = "text", wanted: list[str] = ROLES) -> DataFrame:
    """Adds sections: a struct of the wanted roles' bodies, NULL where a role is absent."""
    own = _with_pieces(docs, text)
    return own.withColumn("sections", sections_of(F.col("_pieces"), bounds_of(F.col("_pieces"), F.col("_fuzzy")), wanted)).drop("_pieces", "_fuzzy")
