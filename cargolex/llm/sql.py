"""DuckDB SQL of the queries that SQL can express on whole tables."""

from . import licenses, line_dedup, mixing

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[ \t\n\x0B\f\r]"

SQL = {
    "op6_line_dedup": rf"""
with lines as (
  select doc_id, source, i, l as line, regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g') as core
  from (select doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents where text is not null)),
totals as (select source, count(*) as n_pages from documents group by source),
marked as (
  select l.source, l.core from lines l join totals t on l.source is not distinct from t.source where l.core <> ''
  group by l.source, l.core, t.n_pages
  having count(distinct l.doc_id) >= {line_dedup.MIN_PAGES} and count(distinct l.doc_id) > t.n_pages * {line_dedup.MAX_RATIO}),
flagged as (select l.*, m.core is not null as gone from lines l left join marked m on l.source is not distinct from m.source and l.core = m.core)
select d.doc_id, d.source, count(f.i) as n_lines, coalesce(sum(f.gone::bigint), 0)::bigint as n_dropped,
  md5(coalesce(string_agg(f.line, chr(10) order by f.i) filter (where not f.gone), '')) as kept_md5
from documents d left join flagged f on d.doc_id = f.doc_id group by d.doc_id, d.source""",
    "op8_source_mixing": rf"""
with docs as (
  select doc_id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::bigint as n_tokens from documents),
sources as (select source, count(*) as n_docs, sum(n_tokens)::bigint as total from docs group by source),
shares as (select source, total / sum(total) over () as p from sources where total > 0),
grid as (select k::bigint as k from range(0, {mixing.STEPS + 1}) t(k)),
terms as (
  select k, count(*) as n, sum(p ** (k / {mixing.STEPS}.0::double)) as s, sum(p ** (k / {mixing.STEPS}.0::double) * ln(p)) as t, max(p ** (k / {mixing.STEPS}.0::double) / p) as most
  from grid, shares group by k),
measured as (select k, case when n < 2 then 1.0 else (ln(s) - k / {mixing.STEPS}.0::double * t / s) / ln(n) end as evenness, case when n < 2 then 0.0 else most / s end as passes from terms),
even as (select coalesce(max(k), 0) as k from measured where evenness >= {mixing.TARGET_ENTROPY}),
power as (select coalesce(min(m.k), {mixing.STEPS}) / {mixing.STEPS}.0::double as a from measured m, even e where m.k >= e.k and m.passes <= {mixing.MAX_REPEATS}),
weights as (select source, n_docs, total, case when total > 0 then (total / sum(total) over ()) ** (select a from power) else 0.0 end as w, sum(total) over () as everything from sources),
quota as (select source, n_docs, total, floor(everything * w / sum(w) over ())::bigint as q from weights),
keyed as (
  select d.*, q.total, q.q, r, r % ceil(q.n_docs / {mixing.BLOCK_DOCS}.0)::bigint as block
  from (select *, ('0x' || substr(md5('mix|' || doc_id), 1, 12))::bigint as r from docs) d join quota q using (source)),
placed as (select *, coalesce(sum(n_tokens) over (partition by source order by block, r, doc_id rows between unbounded preceding and 1 preceding), 0) as place from keyed)
select doc_id, source, n_tokens, (case when n_tokens > 0 then q // total + (place < q % total)::bigint else 0 end)::bigint as n_copies from placed""",
    "op9_decontamination": rf"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD9}') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD9}') from benchmark),
item_windows as (
  select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from words where side = 'i' and len(w) > 0)),
lengths as (select distinct n from item_windows),
doc_windows as (
  select id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where side = 'd' and len(w) >= n)),
hits as (select d.id, d.i, d.n, m.item_id from doc_windows d join item_windows m on d.n = m.n and d.win = m.win),
covered as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hits) group by id),
found as (select id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct id, item_id::varchar as s from hits) group by id)
select w.id as doc_id, len(w.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
  sha256(coalesce(f.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from words w left join covered c on w.id = c.id left join found f on w.id = f.id where w.side = 'd'""",
}

SQL["op11_ranked_search"] = rf"""
with docs as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
corpus as (select count(*) as n_docs, sum(len(w))::bigint as n_all from docs where len(w) > 0),
asked as (
  select item_id, t, count(*) as times
  from (select item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by item_id, t),
postings as (
  select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from docs) where t in (select t from asked) group by r, doc_id, n, t),
weights as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*) as df from postings group by t), corpus),
impacts as (
  select r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_all)))) as impact
  from postings join weights using (t), corpus),
scores as (select item_id, r, doc_id, sum(times * impact)::bigint as score from asked join impacts using (t) group by item_id, r, doc_id having sum(times * impact) > 0),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""

# CRC-32 a byte at a time, its table from eight shifts; a pair of words is near if it has a pattern with one code point masked, or taken out, in common
SQL["op12_spelling_variants"] = r"""
with recursive crc_table as (
  select list(v order by b) as tab
  from (select b, list_reduce([b] || list_transform(range(8), lambda x: 0::bigint), lambda c, y: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v
        from (select unnest(range(256))::bigint as b))),
runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents) where length(r) >= 7 group by 1, 2),
bytes as (
  select r, n, list_concat(list_transform(string_split(coalesce(doc_id::varchar, '') || ':', ''), lambda c: ord(c)::bigint),
    flatten(list_transform(string_split(r, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, 128 + ord(c)::bigint % 64] end))) as b from runs),
hashed as (
  select r, n, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8)), 4294967295::bigint) as h from bytes, crc_table),
made as (select case when h % 31 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from hashed),
words as (select word, sum(n)::bigint as n from made where length(word) >= 7 group by word having sum(n) >= 2),
positions as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
masked as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as m from positions),
cut as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as m from positions),
near as (
  select a.word, b.word as other, b.n as m from masked a join masked b on a.m = b.m and a.word <> b.word
  union all select c.word, w.word, w.n from cut c join words w on c.m = w.word
  union all select w.word, c.word, c.n from cut c join words w on c.m = w.word),
best as (select word, count(*) as n_near, min(struct_pack(neg := -m, other := other)) as b from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -b.neg >= 10 * w.n then b.other end as form, case when -b.neg >= 10 * w.n then -b.neg end as form_n
  from words w left join best b using (word)),
chain as (select word, word as here, 0 as d from formed union all select c.word, f.form, d + 1 from chain c join formed f on c.here = f.word where f.form is not null),
ends as (select word, max_by(here, d) as root from chain group by word)
select f.word, f.form, l.root, f.n, f.n_near, f.form_n::bigint as form_n from formed f join ends l using (word)"""

SQL["op13_exact_dedup"] = rf"""
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, {_LOWERED} as t from documents)"""


#: Licenses of one SPDX expression that the SQL takes apart; the operator has no bound.
_TAGS = 8


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known_sentences().items())
    rules = []
    for i, (name, wanted) in enumerate(licenses.RULES):
        # identifiers are kept as ',id,' so that one cannot be found inside another
        rules.append(f"({i}, {quoted(name)}, {quoted('%' + '%'.join(f',{w},' for w in wanted) + '%')})")
    instead = " ".join(f"and not (r.name = '{a}' and exists (select 1 from hits h where h.doc_id = r.doc_id and h.name = '{b}'))" for a, b in licenses.INSTEAD.items())
    sub = lambda t, found, put: f"regexp_replace({t}, {quoted(found)}, {put if put.startswith('chr') else quoted(put)}, 'g')"
    # tags, and what would cut known sentences
    one = r"[(]*([a-z0-9.+-]*[a-z0-9+-])[)]*(?:[ \t]+with[ \t]+[a-z0-9.+-]*[a-z0-9+-][)]*)?"
    uncut = sub(sub(sub("t", r"(gpl-[0-9]\.[0-9])\+", r"\1-or-later"), licenses.PLUS, r"\1 or later"), rf"spdx-license-identifier:[ \t]*{one}", r". spdx-license-identifier \1. ")
    for _ in range(_TAGS - 1):
        uncut = sub(uncut, rf"(spdx-license-identifier [a-z0-9.+-]*[a-z0-9+-]\. )[ \t]+(?:and|or)[ \t]+{one}", r"\1. spdx-license-identifier \2. ")
    uncut = sub(sub(sub(uncut, r"\bv\.([ \t\r\n*#/]+[0-9])", r"v\1"), r"software foundation[;:]([ \t\r\n*#/]+either )", r"software foundation\1"), "\\(the [\"“”']*licen[sc]e[\"“”']*\\)", "")
    cut = lambda t: f"string_split({sub(t, '[.!?;:]+[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+|[.!?;:]+$|' + chr(92) + 'n', 'chr(10)')}, chr(10))"
    joined = r"replace(regexp_replace(u, '[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*', '. ', 'g'), chr(10), ' ')"
    # what varies in notices
    plain = "s"
    for found, put in licenses.VARIANTS:
        plain = f"regexp_replace({plain}, {quoted(found)}, {'chr(10) || ' + quoted(put[1:]) if put.startswith(chr(10)) else quoted(put)}, 'g')"
    return rf"""
with known(s, id) as (values {known}),
rules(rank, name, pattern) as (values {", ".join(rules)}),
lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
uncut as (select doc_id, {uncut} as u from lowered where regexp_matches(t, '{licenses.HINT}')),
cuts as (select doc_id, 0 as reading, {cut("u")} as parts from uncut union all select doc_id, 1, {cut(joined)} from uncut),
sentences as (
  select doc_id, reading, trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) as s, i
  from (select doc_id, reading, unnest(parts) as p, generate_subscripts(parts, 1) as i from cuts)),
subjects as (select doc_id, reading, i, case when regexp_matches(s, {quoted(licenses.NO_SUBJECT)}) then s else regexp_replace(s, {quoted(licenses.SUBJECT)}, '\1 under ') end as s from sentences),
forms as (
  select doc_id, reading, i, string_split(case when regexp_matches(s, {quoted(licenses.OPENED)}) then {plain} when regexp_matches(s, {quoted(licenses.HOLDER)}) then {quoted(licenses.HELD)} else s end, chr(10)) as f from subjects),
items as (select doc_id, reading, i, unnest(f) as s, generate_subscripts(f, 1) as j from forms),
read as (
  select doc_id, reading, count(*) as n, string_agg(k.id, ',' order by i, j) as ids, string_agg(',' || k.id || ',', '' order by i, j) as marked
  from items x join known k on x.s = k.s group by doc_id, reading),
best as (select doc_id, max_by(struct_pack(n, ids), n * 2 - reading) as b from read group by doc_id),
hits as (select doc_id, name, min(rank) as rank from read, rules where marked like pattern group by doc_id, name),
named as (select r.doc_id, string_agg(r.name, ',' order by r.rank) as names from hits r where true {instead} group by r.doc_id)
select d.doc_id, coalesce(b.n, 0)::bigint as n_sentences, coalesce(b.ids, '') as sentence_ids, coalesce(n.names, '') as licenses
from documents d left join best using (doc_id) left join named n using (doc_id)"""


SQL["op10_license_scan"] = _license_sql()
