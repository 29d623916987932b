"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

#: Tables of a recursive query for the CRC-32 of short texts of code points below 256: its table of bytes as one list.
CRC_TABLE = """crc_bits(i, k, c) as (select i, 0, i::ubigint from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from crc_bits where k < 8),
crc_table as (select list(c order by i) as bytes from crc_bits where k = 8)"""


def crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8, where ``crc_table`` is joined."""
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    utf8 = f"flatten(list_transform({points}, lambda x: case when x < 128 then [x::ubigint] else [(192 + (x >> 6))::ubigint, (128 + (x & 63))::ubigint] end))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {utf8}), lambda c, b: xor(c >> 8, bytes[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint)"


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value} end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL: dict[str, str] = {
    "op2_chat_formatting": """
select conv_id, turn, role, 'text' as kind,
  to_json(struct_pack(content := coalesce(text, ''), role := coalesce(role, '')))::varchar as json,
  0::bigint as n_calls, 0::bigint as n_linked
from conversations""",
    "tool_call_links": """
with recursive m as (select conv_id, turn, case when role = 'user' and turn > 0 then 'tool' else role end as role, length(coalesce(text, '')) as n from conversations),
calls as (select conv_id, turn, n, case when turn % 4 = 1 then 'count' else 'name' end as name from m where role = 'assistant'),
chain as (
  select conv_id, turn, 0::bigint as level from calls c where turn % 6 <> 5 and not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
  union all
  select c.conv_id, c.turn, chain.level + 1 from chain join calls c on c.conv_id = chain.conv_id and c.turn = chain.turn + 2 where c.turn % 6 <> 5),
answers as (select conv_id, turn - 1 as of_turn, turn as result_turn, 'r' || n as result from m where role = 'tool'),
wrong as (
  select conv_id, turn, case when n % 3 = 0 and name = 'count' then 'missing:chars' end as p from calls
  union all select conv_id, turn, case when n % 5 = 0 and name = 'name' then 'missing:label' end from calls
  union all select conv_id, turn, case when n % 3 > 0 and name = 'name' then 'type:chars' end from calls
  union all select conv_id, turn, case when n % 7 = 0 then 'unknown:odd' end from calls),
problems as (select conv_id, turn, string_agg(p, ',' order by p) as problems from wrong where p is not null group by all)
select c.conv_id, 'c' || c.turn as call_id, c.turn, chain.level, c.name,
  '{' || array_to_string(list_filter([case when n % 3 > 0 then '"chars":' || n end, case when n % 5 > 0 then '"label":"' || c.turn || '"' end, case when n % 7 = 0 then '"odd":true' end], lambda x: x is not null), ',') || '}' as arguments,
  a.result_turn, a.result, coalesce(p.problems, '') as problems,
  case when chain.level is null then 'cycle' when a.result_turn is null then 'no result' else 'linked' end as status
from calls c left join chain on chain.conv_id = c.conv_id and chain.turn = c.turn
left join answers a on a.conv_id = c.conv_id and a.of_turn = c.turn
left join problems p on p.conv_id = c.conv_id and p.turn = c.turn""",
    "op4_secret_scans": r"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
rules(kind, k, re, grp, least_chars) as (values
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]{16,}', 0, 20),
  ('hex', 2, '[0-9a-f]{24,}', 0, 24),
  ('github', 3, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0),
  ('slack', 4, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0),
  ('google', 5, 'AIza[0-9A-Za-z_-]{35}', 0, 0),
  ('stripe', 6, 'sk_live_[0-9a-zA-Z]{16,}', 0, 0),
  ('jwt', 7, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0),
  ('pem', 8, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0)),
found as (
  select doc_id, kind, k, least_chars, regexp_extract_all(t, re, 0) as m, string_split_regex(t, re) as g,
    case when grp = 2 then regexp_extract_all(t, re, 2) else regexp_extract_all(t, re, 0) end as v
  from docs, rules where regexp_matches(t, re)),
each_one as (select *, unnest(range(1, len(m) + 1)) as i from found),
placed as (
  select doc_id, kind, k, least_chars, length(v[i]) as n, length(m[i]) as len,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s
  from each_one),
spans as (select doc_id, kind, k, s, s + len as e from placed where n >= least_chars),
folded as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3), '') as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join folded f on d.doc_id = f.doc_id""",
    "op7_benchmark_decontamination": r"""
with low as (
  select 'd' as side, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
cut as (select side, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w from low),
sized as (select side, id, w, len(w) as n from cut),
lens as (select distinct least(n, 10) as len from sized where side = 'b' and n > 0),
wins as (
  select distinct id as item_id, len, array_to_string(w[i : i + len - 1], ' ') as win
  from (select id, w, least(n, 10) as len, unnest(range(1, n - least(n, 10) + 2)) as i from sized where side = 'b' and n > 0)),
spots as (
  select id as doc_id, len, i, array_to_string(w[i : i + len - 1], ' ') as win
  from (select s.id, s.w, l.len, unnest(range(1, s.n - l.len + 2)) as i from sized s, lens l where s.side = 'd' and s.n >= l.len)),
hits as (select s.doc_id, s.i, s.len, w.item_id from spots s join wins w on s.len = w.len and s.win = w.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + len)) as p from hits) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select s.id as doc_id, s.n::bigint as n_words, coalesce(p.n_hit, 0)::bigint as n_hit, coalesce(q.n_items, 0)::bigint as n_items,
  sha256(coalesce(q.items, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from sized s left join words p on s.id = p.doc_id left join named q on s.id = q.doc_id
where s.side = 'd'""",
    "op11_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
x as (select page_id, strlen(html) as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as top from p),
n as (select *, list_transform(range(8), lambda g: ('0x' || h[g * 5 + 1 : g * 5 + 5])::int) as fives from x)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from n""",
    "op12_merkle_manifest": f"""
with recursive {CRC_TABLE},
d as (select doc_id, source, {_leaf('text')} as leaf, case when {crc32('doc_id::varchar')} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} end as now from documents, crc_table),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from d),
t(source, lvl, idx, cnt, d) as (select source, 0, pos, n, leaf from p
  union all select source, lvl + 1, idx // 3, (cnt + 2) // 3, sha256(string_agg(d, '' order by idx)) from t where cnt > 1 group by source, lvl, idx // 3, cnt),
sub as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as spos, count(*) over () as sn from t where cnt = 1),
s(lvl, idx, cnt, d) as (select 0, spos, sn, subroot from sub union all select lvl + 1, idx // 3, (cnt + 2) // 3, sha256(string_agg(d, '' order by idx)) from s where cnt > 1 group by lvl, idx // 3, cnt),
near as (select source, lvl, idx, coalesce(lag(d, 2) over w, '') || coalesce(lag(d) over w, '') as l, coalesce(lead(d) over w, '') || coalesce(lead(d, 2) over w, '') as r from t where cnt > 1 window w as (partition by source, lvl, idx // 3 order by idx)),
snear as (select lvl, idx, coalesce(lag(d, 2) over w, '') || coalesce(lag(d) over w, '') as l, coalesce(lead(d) over w, '') || coalesce(lead(d, 2) over w, '') as r from s where cnt > 1 window w as (partition by lvl, idx // 3 order by idx)),
steps as (select p.doc_id, p.source, near.lvl as k, l, r from p join near on near.source is not distinct from p.source and near.idx = p.pos // (3 ** near.lvl)::bigint
  union all select p.doc_id, p.source, 1000 + snear.lvl, l, r from p join sub on sub.source is not distinct from p.source join snear on snear.idx = sub.spos // (3 ** snear.lvl)::bigint),
path as (select doc_id, k, row_number() over (partition by doc_id order by k) as step, l, r from steps),
proof as (select doc_id, sha256(string_agg(l || r, '' order by step)) as proof from path group by doc_id),
f(doc_id, step, d) as (select doc_id, 0, coalesce(now, leaf) from d union all select f.doc_id, f.step + 1, sha256(l || f.d || r) from f join path on path.doc_id = f.doc_id and path.step = f.step + 1),
folded as (select doc_id, arg_max(d, step) as root from f group by doc_id),
top as (select d as root from s where cnt = 1)
select p.doc_id, p.leaf, sub.subroot, top.root, coalesce(proof, sha256('')) as proof_sha256, folded.root as folded_root, folded.root = top.root as verified
from p join sub on sub.source is not distinct from p.source join folded on folded.doc_id = p.doc_id left join proof on proof.doc_id = p.doc_id, top""",
    "op13_spelling_variants": f"""
with recursive {CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents),
once as (select doc_id, w, length(w) as len, count(*) as n from runs group by all),
summed as (select w, len, n, {crc32("doc_id || ':' || w")} as h from once, crc_table),
cut as (select case when h % 97 = 0 then w[:(h % len)::bigint] || w[(h % len)::bigint + 2:] else w end as word, n from summed),
words as (select word, sum(n)::bigint as n from cut group by word having length(word) >= 5 and sum(n) >= 3),
gone as (select word, n, i, word[:i - 1] || word[i + 1:] as rest from words, unnest(range(1, length(word) + 1)) as r(i)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from gone a join gone b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from gone a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from gone a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, (list(other order by other_n desc, encode(other)))[1] as form, max(other_n) as form_n from near group by word),
forms as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * words.n then form end as form, case when form_n >= 2 * words.n then form_n end as form_n from words left join best on best.word = words.word),
follow(word, root, step) as (select word, word, 0 from forms union all select follow.word, forms.form, step + 1 from follow join forms on forms.word = follow.root where forms.form is not null),
last as (select word, arg_max(root, step) as root from follow group by word)
select forms.word, form, root, n, n_near, form_n from forms join last on last.word = forms.word""",
}
