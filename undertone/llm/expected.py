"""What queries of this folder return, in SQL for DuckDB. Queries without an entry are tested by brute force."""

SQL = {}

SQL["op2_warc"] = """
with p as (select page_id, coalesce(encode(html), ''::blob) as body from pages),
d as (select page_id, octet_length(body) as n, sha256(body) as digest from p),
f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first <> page_id then first end as refers_to
from f"""

SQL["op3_ngram_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select doc_id, case when coalesce(len(words), 0) = 0 then []
    when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct([array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)]) end as grams
  from w),
g as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as node, doc_id as root from documents
  union select links.b, reach.root from reach join links on reach.node = links.a)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles, min(reach.root) as component_id
from s join reach on reach.node = s.doc_id group by all"""

SQL["op4_top_k_search"] = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as w from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.w, c.w)]) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20"""

SQL["op6_line_dedup"] = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents),
k as (
  select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l),
hot as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, hot.key is not null as dropped from k left join hot on k.key = hot.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from m group by doc_id"""

SQL["op10_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(replace(text, '\', '\s'), '</turn>', '\e'), '### ', '\h'), '<+>', '\j') as body,
    replace(replace(replace(replace(replace(role, '\', '\s'), '</turn>', '\e'), '### ', '\h'), '<+>', '\j'), chr(10), '\n') as head,
    coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as joined
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(body) + case when joined then 3 else length(head) + 5 + 8 end) as bigint) as formatted_chars
from e group by conv_id"""

SQL["op12_turn_repair"] = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(
      [ord(c)::bigint for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')],
      lambda crc, b: list_reduce([0::bigint, 1, 2, 3, 4, 5, 6, 7],
        lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, b)),
      4294967295::bigint), 4294967295::bigint) % 20 as kind
  from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when kind = 0 then [] when kind = 3 then [0, 1] else [0] end) as copy
  from src),
f as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as place,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, nth) as before,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as ending
  from (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from d)),
t as (
  select *, case when ending = '' then 'blank' when nth > 1 then 'duplicate'
      when ending not in ('.', '!', '?') then 'truncated' else '' end as fault,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as initial,
  from f),
c as (
  select s.conv_id, count(t.place) as n,
    coalesce(max(t.turn) - min(t.turn) + 1 - count(distinct t.turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from (select distinct conv_id from src) s left join t on s.conv_id is not distinct from t.conv_id group by s.conv_id),
-- Cheapest edits of the rows from i on, by what may come next: s or u (z), u (h, u), a (a); h has had its s.
walk as (
  select conv_id, n as i, {c: 0::bigint, e: ''} as z, {c: 10::bigint, e: 'II'} as h, {c: 0::bigint, e: ''} as u,
    {c: 5::bigint, e: 'I'} as a
  from c
  union all
  select conv_id, i, least(z, {c: a.c + 5, e: 'I' || a.e}) as z, least(h, {c: a.c + 5, e: 'I' || a.e}) as h,
    least(u, {c: a.c + 5, e: 'I' || a.e}) as u, a
  from (
    select conv_id, i, z, h, u, least(a, {c: u.c + 5, e: 'I' || u.e}) as a
    from (
      select w.conv_id, i - 1 as i,
        case when gone then {c: 2 + z.c, e: 'D' || z.e} else least({c: 2 + z.c, e: 'D' || z.e},
          {c: extra + h.c + case when initial = 's' then 0 else 1000000 end, e: 'K' || h.e},
          {c: extra + a.c + (initial <> 'u')::int, e: if(initial = 'u', 'K', 'R') || a.e}) end as z,
        case when gone then {c: 2 + h.c, e: 'D' || h.e} else least({c: 2 + h.c, e: 'D' || h.e},
          {c: extra + a.c + (initial <> 'u')::int, e: if(initial = 'u', 'K', 'R') || a.e}) end as h,
        case when gone then {c: 2 + u.c, e: 'D' || u.e} else least({c: 2 + u.c, e: 'D' || u.e},
          {c: extra + a.c + (initial <> 'u')::int, e: if(initial = 'u', 'K', 'R') || a.e}) end as u,
        case when gone then {c: 2 + a.c, e: 'D' || a.e} else least({c: 2 + a.c, e: 'D' || a.e},
          {c: extra + u.c + (initial <> 'a')::int, e: if(initial = 'a', 'K', 'R') || u.e}) end as a
      from walk w join (select *, fault in ('blank', 'duplicate') as gone, if(fault = 'truncated', 5, 0) as extra from t) t
        on w.conv_id is not distinct from t.conv_id and t.place = w.i))),
best as (select conv_id, z.c as cost, z.e as audit from walk where i = 0),
steps as (
  select conv_id, audit, p, substr(audit, p, 1) as edit, p - len(replace(left(audit, p), 'I', '')) as put,
    len(replace(left(audit, p), 'I', '')) as place, len(replace(left(audit, p), 'D', '')) as nth
  from (select *, unnest(range(1, len(audit) + 1)) as p from best)),
turns as (
  select s.conv_id, p, edit, s.nth, case when edit = 'I' then '' else t.text end as text, t.role,
    bool_or(s.nth = 1 and edit = 'K' and initial = 's') over (partition by s.conv_id) as headed
  from steps s left join t on s.conv_id is not distinct from t.conv_id and s.place = t.place and edit <> 'I'
  where edit <> 'D'),
lines as (
  select conv_id, string_agg(
    case when edit = 'K' then role when (nth + headed::int) % 2 = 1 then 'user' else 'assistant' end || ':' || text,
    chr(10) order by p) as whole
  from turns group by conv_id)
select c.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
from c join best on c.conv_id is not distinct from best.conv_id
  left join lines on c.conv_id is not distinct from lines.conv_id"""

SQL["op13_lexical_rank"] = r"""
with w as (
  select *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from (select row_number() over () as row, doc_id, text from documents)),
s as (select count(*) as many, sum(len(words))::bigint as total from w where len(words) > 0),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
p as (
  select row, doc_id, term, n, count(*) as tf
  from (select row, doc_id, len(words) as n, unnest(words) as term from w) where term in (select term from q) group by all),
v as (
  select term, floor(1000 * ln((2 * many + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
  from p, s group by term, many),
r as (
  select item_id, row, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * many) // total))))::bigint as score
  from q join p using (term) join v using (term), s group by all)
select item_id, rank::integer as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from r where score > 0)
where rank <= 10"""
