"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import line_dedup, quality, recompression, sharding

_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op1() -> str:
    assert line_dedup.MIN_LINES == 2
    return f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) x, generate_subscripts(ls, 1) i from d),
k as (select doc_id, i, x, lead(x) over w nx, lead(i) over w ni from l where regexp_matches(x, '{_WORD}') window w as (partition by doc_id order by i)),
f as (select doc_id, i, ni, row_number() over (partition by x, nx order by doc_id, i) r from k where ni is not null),
gone as (select doc_id, i from f where r > 1 union select doc_id, ni from f where r > 1)
select doc_id, count(*) n_lines, count(g.i) n_removed, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where g.i is null), '')) kept_sha256
from l left join (select doc_id, i from gone) g using (doc_id, i) group by doc_id"""


def op1_long() -> str:
    """As op1, and a line of many words counts as a run by itself."""
    assert line_dedup.MIN_LINES == 2
    return f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) x, generate_subscripts(ls, 1) i from d),
k as (select doc_id, i, x, lead(x) over w nx, lead(i) over w ni from l where regexp_matches(x, '{_WORD}') window w as (partition by doc_id order by i)),
f as (select doc_id, i, ni, row_number() over (partition by x, nx order by doc_id, i) r from k where ni is not null),
o as (select doc_id, i, row_number() over (partition by x order by doc_id, i) r from k where len(regexp_extract_all(x, '{_WORD}+')) >= {line_dedup.LONG_WORDS}),
gone as (select doc_id, i from f where r > 1 union select doc_id, ni from f where r > 1 union select doc_id, i from o where r > 1)
select doc_id, count(*) n_lines, count(g.i) n_removed, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where g.i is null), '')) kept_sha256
from l left join (select doc_id, i from gone) g using (doc_id, i) group by doc_id"""


def op2() -> str:
    q = quality
    words = f"len(string_split_regex(trim(x), '{_GAP}'))"
    count = lambda p: f"len(regexp_extract_all(x, {_quoted(p)}))"
    boiler = "(" + " or ".join(f"contains(lower(x), {_quoted(p)})" for p in q.BOILERPLATE) + ")"
    fails = f"""regexp_matches(x, '{_WORD}') and (
      {boiler} or len(string_split(x, '|')) > 3 or regexp_matches(x, {_quoted(q.MENU)})
      or (not regexp_matches(x, {_quoted(q.END_MARKS)}) and ({words} < {q.PROSE_WORDS} or not regexp_matches(x, {_quoted(q.INNER_END)})))
      or {count(q.SYMBOLS)} * 4 > {words} or (len(string_split(x, '{q.SHOUTS}')) - 1) * 4 > {words})"""
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '{_GAP}'), lambda x: x <> '') w, string_split(t, chr(10)) l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + o) n from r, (values (0), (1), (2)) t(o) group by doc_id),
b as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
  len(regexp_extract_all(t, {_quoted(q.SYMBOLS)}))::bigint n_symbols,
  (len(list_filter(l, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '{_WORD}')))))::bigint n_dup_lines,
  coalesce(c.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines, list_filter(l, lambda x: not ({fails})) k from w left join c using (doc_id)),
s as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words base_failed, (n_lines - len(k))::bigint n_failed_lines,
  (word_chars - coalesce(list_sum(list_transform(k, lambda x: length(regexp_replace(x, '{_GAP}', '', 'g')))), 0))::bigint lost_chars from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost_chars <= {q.MAX_LOST_PERCENT} * word_chars kept, n_lines, n_failed_lines, lost_chars from s"""


def op3() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_GAP}'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) i from w)),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
u as (select a, b from e union select b, a from e),
r as (select doc_id a, doc_id b from documents union select r.a, u.b from r join u on r.b = u.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.b) component_id from documents d left join n using (doc_id) left join r on r.a = d.doc_id group by d.doc_id"""


def op3_links() -> str:
    """As op3, with the class (texts of equal sets) and its links to others."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_GAP}'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) i from w)),
n as (select doc_id, count(*) n, min(doc_id) over (partition by list_sort(list(g))) class_id from s group by doc_id),
o as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b, x.class_id ca, y.class_id cb from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
u as (select a, b from e union select b, a from e),
c as (select ca, count(distinct cb) n_links from (select ca, cb from e union select cb, ca from e) where ca <> cb group by ca),
r as (select doc_id a, doc_id b from documents union select r.a, u.b from r join u on r.b = u.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.b) component_id, coalesce(any_value(n.class_id), d.doc_id) class_id, coalesce(any_value(c.n_links), 0)::bigint n_links
from documents d left join n using (doc_id) left join c on c.ca = n.class_id left join r on r.a = d.doc_id group by d.doc_id"""


def op7() -> str:
    k = recompression.WINDOW
    return f"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') w from documents),
g as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + {k - 1}], ' ') order by doc_id, i) r from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) i from w where len(w) >= {k})),
gone as (select distinct doc_id, i + o i from g, range(0, {k}) t(o) where r > 1),
p as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from w),
k as (select doc_id, count(*) n_words, count(gone.i) n_removed, sha256(coalesce(string_agg(x, ' ' order by i) filter (where gone.i is null), '')) h from p left join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, coalesce(h, sha256('')) kept_sha256 from documents left join k using (doc_id)"""


def op9() -> str:
    revisit = "strlen(h) >= 100 and page_id <> first"
    return f"""
with p as (select page_id, coalesce(html, '') h, min(page_id) over (partition by coalesce(html, '')) first from pages)
select page_id, strlen(h) payload_bytes, sha256(h) payload_digest, case when {revisit} then 'revisit' else 'response' end record_type, case when {revisit} then first end refers_to from p"""


def op5(shards: tuple[str, ...]) -> str:
    table = sharding.fill(shards)
    return f"""
with t as (select {table} t),
s as (select doc_id, (('0x' || left(md5(coalesce(doc_id::varchar, '')), 15))::bigint % {len(table)})::int slot from documents),
n as (select doc_id, slot, t.t[slot + 1]::int shard from s, t)
select doc_id, slot, shard, {list(shards)}[shard + 1] shard_name from n"""
