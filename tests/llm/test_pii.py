import hashlib
import random
import re
import time

from cargolex.llm import pii

_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, p in enumerate(_PATTERNS):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            odd, even = d[-1::-2], d[-2::-2]
            ok = [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0, 9 <= len(d) <= 15]
            if ok[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_as_by_the_patterns():
    rnd = random.Random(2)
    for _ in range(20000):
        text = "".join(rnd.choices("a1@.+ -(9é_%0", k=rnd.randint(0, 40)))
        assert pii.plain(text) == brute(text), text
    card = "x 4539 1488 0343 6467, 4539-1488-0343-6468 +1 (555) 123-4567 a@b@c.de.f 300.1.2.3 1.2.3.4.5.6.7.8"
    assert pii.plain(card) == brute(card) and len(brute(card)) >= 5


def spans(text):
    base = pii.plain(text)
    return {(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, base)}


def test_disguises_are_mapped_back():
    assert spans("write to ann (at) mail (dot) example.com now") == {("email", "ann (at) mail (dot) example.com")}
    assert spans("ann.lee at mail dot example dot org, please") == {("email", "ann.lee at mail dot example dot org")}
    assert spans("bob[at]host[.]net") == {("email", "bob[at]host[.]net")}
    assert spans("аnn＠exаmple.com") == {("email", "аnn＠exаmple.com")}
    assert spans("a​nn@exa​mple.com é") == {("email", "a​nn@exa​mple.com")} or pii.plain("a​nn@exa​mple.com")
    assert spans("call plus one two three four five six seven eight nine zero today") == {("phone", "plus one two three four five six seven eight nine zero")}
    assert spans("４５３９ １４８８ ０３４３ ６４６７") == {("card", "４５３９ １４８８ ０３４３ ６４６７")}
    assert spans("192[.]168[.]0[.]1") == {("ip", "192[.]168[.]0[.]1")}


def test_disguises_without_other_signs():
    for text in ("jane@example dot com", "jane at example.it", "jane at mail.example.nl", "jane (ARROBA) host (PUNTO) es", "jane at example Dot com", "jane AT EXAMPLE.COM", "Jane at Example dot Com", "Jane at Example.Com"):
        for more in ("", " \u00a0–"):
            assert spans(text + more) == {("email", text)}, text
    assert spans("192 dot 168 dot 0 dot 1") == {("ip", "192 dot 168 dot 0 dot 1")}
    for text in ("we met at noon.Then on", "look at 3.5 percent", "see at e.g. home", "I am at home – one.", "at 12.30 and"):
        assert not spans(text), text


def test_partly_disguised():
    for kind, text in (("email", "jаne.doe@example.com"), ("email", "ja\u200bne.doe@example.com"), ("email", "jane@mail.exаmple.com"), ("ip", "192.168.1.1０"), ("email", "jane@mail.example dot com")):
        assert pii.plain(text) and spans(text) == {(kind, text)}, text
    assert not spans("a\u00a0– jane.doe@example.com 10.0.0.1 one")


def test_spelled_digits_in_short_runs():
    ips = ("one nine two dot one six eight dot zero dot one", "one two seven dot zero dot zero dot one", "192.168.zero.one", "uno.zwei.trois.4")
    for kind, text in [("ip", x) for x in ips] + [("phone", "plus four nine 151 2345678"), ("phone", "+49 one five 1 2345678"), ("card", "4539 1488 0343 64 six seven"), ("card", "4539 1488 0343 64, six - seven"), ("card", "four five 39 1488 0343 6467")]:
        for more in ("", " and", ". One"):
            assert spans(text + more) == {(kind, text)}, text
    assert not spans("call +1 (848) 555-1373 Un jour, +1 (848) 555-1373. Two")
    assert not spans("three, two dot one. One plus one is two; ſix SİX fıve one in 2 at 3 or four.")


def test_foreign_digits_and_letters():
    styled = lambda text, a, zero: "".join(chr(ord(c) - 97 + a) if c.isalpha() else chr(ord(c) - 48 + zero) if c.isdigit() else c for c in text)
    for zero in (0x9E6, 0xE50, 0x1D7CE, 0x660):
        assert spans("x " + styled("192.168.0.1", 0, zero)) == {("ip", styled("192.168.0.1", 0, zero))}
    for a in (0x1D41A, 0x1D5BA, 0x24D0):
        assert spans("x " + styled("jane@mail.com", a, 0)) == {("email", styled("jane@mail.com", a, 0))}
    assert spans("ﬁona@exa\U0001d426ple.com") == {("email", "ﬁona@exa\U0001d426ple.com")}
    assert not spans("x² ½ 😀 №5 ª.º")


def test_clean_prose_is_left_alone():
    for text in ("Look at example. One two three four five six seven!", "meet at noon. Then go", "we are at home (at) last", "one dot two", ""):
        assert not spans(text)


def test_long_texts_take_one_pass():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a." * 150_000, "@" * 300_000, "+1" * 150_000, "one two three " * 30_000, "1." * 150_000, "+" + "1" + " " * 200_000):
        pii.disguised(text, pii.plain(text))
    assert time.time() - began < 30


def test_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "é x@y.zz", 2), (3, "é x@y.zz", 2)], "doc_id long, text string, n_email long")
    rows = pii.find(df).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id, r.n_email, r.spans, r.base_sha256 == none) for r in rows) == [(1, 0, "", True), (2, 0, "", True)] + 2 * [(3, 1, "email:2:8", False)]
    assert pii.find(df.limit(0)).count() == 0
