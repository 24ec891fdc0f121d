"""DuckDB SQL for the registered queries that SQL can express."""

_LEAVES = "select domain, lang, source, sum(n_tokens)::double as tokens from docs group by all"

#: Words as a list, by white space of ASCII.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def _family(level: str, parent: str, source: str) -> str:
    """Shares of one level: ``source`` has the parents' keys, the level, cap, w and budget."""
    part = f"partition by {parent}" if parent else ""
    order = f"({part} order by rate, {level} nulls first"
    return f"""
      select * exclude (w, rate, lv, best), least(cap, greatest(best, 0.0) * w) as budget2 from (
        select *, max(lv) over ({part}) as best from (
          select *, case when sum(w) over {order} rows between current row and unbounded following) > 0
              then (budget - coalesce(sum(cap) over {order} rows between unbounded preceding and 1 preceding), 0.0))
                 / sum(w) over {order} rows between current row and unbounded following) end as lv
          from (select *, case when w > 0 then cap / w else 0.0 end as rate from ({source}))))"""


_OP2 = f"""
with docs as (
  select doc_id, lang, source, len({_WORDS}) as n_tokens,
    case coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as int), 0) % 3 when 0 then 'web' when 1 then 'books' else 'forums' end as domain
  from documents),
leaves as ({_LEAVES}),
a as ({_family("domain", "", "select domain, sum(tokens * 3.0) as cap, (select sum(tokens) from leaves) * 0.8 as budget, case domain when 'web' then 2.0::double else 1.0::double end as w from leaves group by domain")}),
b as ({_family("lang", "domain", "select l.domain, l.lang, sum(l.tokens * 3.0) as cap, any_value(a.budget2) as budget, case l.lang when 'en' then 3.0::double when 'de' then 2.0::double else 1.0::double end as w from leaves l join a on l.domain = a.domain group by l.domain, l.lang")}),
c as ({_family("source", "domain, lang", "select l.domain, l.lang, l.source, l.tokens, l.tokens * 3.0 as cap, b.budget2 as budget, case l.source when 'src0' then 0.5::double else 1.0::double end as w from leaves l join b on l.domain = b.domain and l.lang is not distinct from b.lang")}),
plan as (select domain, lang, source, floor(budget2)::bigint as budget, case when tokens > 0 then floor(floor(budget2) / tokens)::int else 0 end as epochs, tokens from c),
placed as (
  select d.*, p.epochs, p.budget - p.epochs * p.tokens as rest,
    substr(md5(concat_ws(':', '42', p.epochs::varchar, d.doc_id::varchar)), 1, 16) as key
  from docs d join plan p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
summed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row), 0) as upto,
    sum(n_tokens) over (partition by domain, lang, source, key) as own from placed),
cuts as (select domain, lang, source, key as cut, any_value(rest - (upto - own)) as last_take from summed where rest > 0 and upto - own < rest and upto >= rest group by all),
taken as (
  select s.doc_id, s.domain, s.lang, s.source, s.n_tokens, s.epochs, c.cut, c.last_take, s.key,
    s.epochs + case when s.key <= c.cut then 1 else 0 end as n
  from summed s left join cuts c on s.domain = c.domain and s.lang is not distinct from c.lang and s.source is not distinct from c.source),
rounds as (select *, unnest(range(n)) as epoch from taken)
select doc_id, domain, lang, source, epoch::int as epoch, n_tokens::bigint as n_tokens,
  (case when epoch = epochs and key = cut then least(n_tokens, last_take) else n_tokens end)::bigint as take_tokens
from rounds"""

_OP5 = rf"""
with recursive w as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (select u, v from shared join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 85 * (x.n + y.n - k)),
sides as (select u, v from links union all select v, u from links),
reach(doc_id, top) as (
  select doc_id, doc_id from documents
  union
  select sides.v, reach.top from reach join sides on sides.u = reach.doc_id where reach.top < sides.v),
tops as (select doc_id, min(top) as top from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, t.top as component_id, d.doc_id = t.top as kept
from documents d join tops t on t.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""

_OP6 = r"""
with lines as (select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as perspective from lines where speaker <> 'system'),
seen as (
  select l.*, p.perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
  from lines l join people p on l.conv_id is not distinct from p.conv_id),
parts as (select *, '<|im_start|>' || role || case when role = 'user' then ' name=' || speaker else '' end || chr(10) as head from seen),
whole as (select *, head || text || '<|im_end|>' || chr(10) as segment from parts),
placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    row_number() over (partition by conv_id, perspective order by turn nulls first, speaker, text) - 1 as seq
  from whole)
select conv_id, perspective, seq::bigint as seq, turn, speaker, role, segment, start, start + length(head) as loss_start,
  start + length(head) + case when role = 'assistant' then length(text) + 10 else 0 end as loss_end, start + length(segment) as "end"
from placed"""

_OP9 = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, {_WORDS} as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0b\f\r]')) as lines from t),
windows as (select doc_id, i, array_to_string(words[i:i+4], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
hits as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + o) as n from hits, range(5) r(o) group by doc_id),
m as (
  select w.doc_id, len(words) as n_words, length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    length(text) - length(replace(text, '!', '')) as n_exclaims, length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) as n_stops
  from w left join covered c on w.doc_id = c.doc_id),
f as (
  select *, (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 2 * n_dup_lines > n_lines then 8 else 0 end)
    + (case when n_exclaims > 4 and 3 * n_exclaims > n_words then 16 else 0 end) + (case when word_chars > 25 * n_words then 32 else 0 end)
    + (case when 2 * word_chars < 3 * n_words then 64 else 0 end) + (case when n_words >= 50 and n_stops = 0 then 128 else 0 end) as failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed::bigint as failed
from f"""

_OP8 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html) as n, sha1(html) as sha from p),
f as (select sha, min(page_id) as first from h group by sha),
d as (
  select h.page_id, h.n, h.sha, case when h.page_id > f.first then f.first end as refers_to,
    list_transform(range(8), lambda g: ('0x' || substr(h.sha, (g * 5 + 1)::int, 5))::bigint) as groups
  from h join f on h.sha = f.sha)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(groups, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> b) & 31) + 1)::int, 1)), '')), '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from d"""

_OP11 = r"""
with crc_table as (select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) t),
own as (
  select conv_id c, coalesce(role, '') role, coalesce("text", '') body, row_number() over (partition by conv_id order by turn nulls first, role, "text") - 1 r
  from conversations where conv_id is not null),
conv as (
  select c, c - c % 5 b, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 9 h
  from (select distinct c from own), crc_table),
rebuilt as (
  select c, row_number() over (partition by c order by part, r) d, role, body from (
    select v.c, 0 part, o.r, o.role, o.body from conv v join own o on o.c = v.b where o.r < v.h
    union all
    select v.c, 1, o.r, o.role, o.body from conv v join own o on o.c = v.c where o.r >= v.h)),
path as (
  select c, d, string_agg(md5(role || chr(1) || body), '') over (partition by c order by d) k, strlen(body) bytes from rebuilt
  union all
  select c, 0, '', 0 from conv),
node as (select k, any_value(d) d, min(c) c, count(*) n, any_value(bytes) bytes from path group by k),
child as (select n.k, p.k up from node n join path p on p.c = n.c and p.d = n.d - 1),
kids as (select up k, count(*) n from child group by up),
below as (
  select p.k, sum((m.n - 1) * m.bytes) saved, count(*) filter (where q.k is null) leaves
  from node m join path p on p.c = m.c and p.d <= m.d left join kids q on q.k = m.k group by p.k),
ends as (select k, string_agg(c::varchar, ',' order by c) ids from (select c, max(d) d from path group by c) e join path using (c, d) group by k)
select n.c conv_id, n.d::bigint "depth", u.c parent_conv_id, n.n::bigint n_convs, coalesce(q.n, 0)::bigint n_children, b.leaves::bigint n_leaves, b.saved::bigint saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
from node n left join child x on x.k = n.k left join node u on u.k = x.up left join kids q on q.k = n.k left join below b on b.k = n.k left join ends e on e.k = n.k
"""

_OP13 = rf"""
with w as (select doc_id, {_WORDS} as words from (select doc_id, coalesce(text, '') as text from documents)),
windows as (select doc_id, i, array_to_string(words[i:i+12], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13)),
firsts as (select k, min(doc_id) as doc_id from windows group by k having min(doc_id) < max(doc_id)),
gone as (select distinct w.doc_id, i + o as i from windows w join firsts f on f.k = w.k and f.doc_id < w.doc_id, range(13) r(o)),
listed as (select doc_id, list(i) as gone from gone group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then words else list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(gone, i)), lambda i: words[i]) end, ' ')) as kept_sha256
from w left join listed l on l.doc_id = w.doc_id"""

ORACLES: dict[str, str] = {
    "op2_mixing": _OP2,
    "op5_near_dedup": _OP5,
    "op6_chat_views": _OP6,
    "op8_warc_zip": _OP8,
    "op9_rule_ledger": _OP9,
    "op11_prefix_trie": _OP11,
    "op13_substring_dedup": _OP13,
}
