"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""

SQL["op10_pii"] = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
k(kind, rank, rx, lead, tail) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 0, 0),
  ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 0, 0),
  ('card', 2, '[0-9]([\x20-]?[0-9])+', 0, 0),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', 0, 0),
  ('iban', 4, '(^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?($|[^A-Za-z0-9])', 1, 1),
  ('ssn', 5, '(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9-])', 1, 1),
  ('token', 6, '(^|[^A-Za-z0-9])((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})', 1, 0),
  ('secret', 7, '(^|[^A-Za-z0-9])(password|passwd|secret|token|api[_-]?key|access[_-]?key)\x20{0,2}[:=]\x20{0,2}["'']?[A-Za-z0-9+/_.-]{8,}', 1, 0)),
lists as (
  select r, doc_id, t, kind, rank, lead, tail, regexp_extract_all(t, rx) as ms, string_split_regex(t, rx) as gs from d, k
  where regexp_matches(t, rx)),
rows as (
  select r, doc_id, t, kind, rank, lead, tail, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, generate_subscripts(ms, 1) as i from lists),
placed as (
  select *, sum(length(m) + length(g)) over (partition by r, kind order by i) as e from rows),
cut as (
  select r, doc_id, t, kind, rank,
    case when lead = 1 and not regexp_matches(m, '^[A-Za-z0-9]') then substr(m, 2) else m end as m1,
    case when lead = 1 and not regexp_matches(m, '^[A-Za-z0-9]') then e - length(m) + 1 else e - length(m) end as s, tail
  from placed),
spans as (
  select r, doc_id, t, kind, rank, s,
    case when tail = 1 and regexp_matches(m1, '[^A-Z0-9]$') then substr(m1, 1, length(m1) - 1) else m1 end as v from cut),
checked as (
  select *, s + length(v) as e, regexp_replace(v, '[^0-9]', '', 'g') as ds from spans),
good as (
  select * from checked where case kind
    when 'email' then true
    when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda p:
      length(regexp_replace(p, '^0+', '')) <= 3 and cast('0' || right(p, 3) as integer) <= 255))
    when 'card' then length(ds) between 12 and 19 and list_sum(list_transform(range(1, length(ds) + 1), lambda i:
      case when (length(ds) - i) % 2 = 1 then cast(substr(ds, i, 1) as integer) * 2
        - case when cast(substr(ds, i, 1) as integer) > 4 then 9 else 0 end
      else cast(substr(ds, i, 1) as integer) end)) % 10 = 0
    when 'phone' then length(ds) between 9 and 15
    when 'ssn' then regexp_matches(lower(right(substr(t, 1, cast(s as integer)), 40)), '\b(ssn|social security|taxpayer)\b')
    when 'token' then true when 'secret' then true
    else length(replace(v, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0, list_transform(
      string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: ascii(c))),
      lambda a, c: case when c >= 65 then (a * 100 + c - 55) % 97 else (a * 10 + c - 48) % 97 end) = 1
    end),
told as (
  select r,
    count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip,
    count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 4) as base,
    count(*) as n_spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans
  from good group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
  coalesce(n_phone, 0) as n_phone, coalesce(n_spans, 0) as n_spans, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (r)
"""

SQL["op3_quality"] = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang,
    coalesce(source, '') as source from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i
  from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
tri as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from w window o as (partition by r order by i)),
hit as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri where g is not null) where n > 1),
rep as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from hit) group by r),
wc as (select r, count(*) as n, sum(length(w)) as chars from w group by r),
l as (select r, unnest(string_split(t, chr(10))) as l from d),
ln as (select r, count(*) as n, count(*) - count(distinct l) as dup from l where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (
  select d.r, doc_id, lang, source, coalesce(wc.n, 0) as n_words, cast(coalesce(wc.chars, 0) as bigint) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(ln.dup, 0) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, coalesce(ln.n, 0) as n_lines
  from d left join wc using (r) left join rep using (r) left join ln using (r)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    [1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
     1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)] as rates
  from m),
v as (select lang, source, unnest([1, 2, 3, 4]) as rate, unnest(rates) as x from b where not base_failed),
sk as (
  select lang, source, rate, x // (1 << greatest(length(bin(x)) - 6, 0)) * (1 << greatest(length(bin(x)) - 6, 0)) as bin,
    count(*) as n from v group by all),
lv as (
  select 'own' as lv, lang, source, rate, bin, sum(n) as n from sk group by all
  union all select 'lang', lang, '', rate, bin, sum(n) from sk group by all
  union all select 'all', '', '', rate, bin, sum(n) from sk group by all),
rk as (
  select *, sum(n) over (partition by lv, lang, source, rate order by bin) as up_to,
    sum(n) over (partition by lv, lang, source, rate) as total from lv),
q as (
  select lv, lang, source, rate, max(total) as n, min(bin) filter (where 4 * up_to >= total) as q1,
    min(bin) filter (where 4 * up_to >= 3 * total) as q3 from rk group by all),
f as (
  select o.lang, o.source, o.rate,
    case when o.n >= 50 then o.q1 when l.n >= 50 then l.q1 else a.q1 end as q1,
    case when o.n >= 50 then o.q3 when l.n >= 50 then l.q3 else a.q3 end as q3
  from q o join q l on l.lv = 'lang' and l.lang = o.lang and l.rate = o.rate
  join q a on a.lv = 'all' and a.rate = o.rate where o.lv = 'own'),
lim as (
  select lang, source, rate, q3 + 4 * greatest(q3 - q1, [60, 150, 100, 50][rate]) as high,
    case when rate = 4 then q1 - 4 * greatest(q3 - q1, 50) else 0 end as low from f),
ok as (
  select b.r, bool_and(b.rates[lim.rate] between lim.low and lim.high) as inside
  from b join lim using (lang, source) group by b.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(inside, false) as kept
from b left join ok using (r)
"""

SQL["op13_lexical_search"] = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from documents),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
n as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as n_terms from d where len(ws) > 0),
tf as (
  select r, term, count(*) as tf from (select r, unnest(ws) as term from d)
  where term in (select term from i) group by r, term),
w as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from tf group by term), n),
s as (
  select i.item_id, d.doc_id, d.r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n_docs) // n_terms)))) as bigint) as score
  from tf join w using (term) join i using (term) join d using (r), n group by i.item_id, d.doc_id, d.r)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= 50
"""
