"""The corpus queries that SQL can express, as DuckDB SQL over whole tables. Texts stand where the operators use hashes."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op2_repeated_phrases"] = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(range(1, len(w) - 48)) i, w from d where len(w) >= 50),
v as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) h from s),
f as (select h, min(doc_id) m from v group by h),
c as (select doc_id, i from v join f using (h) where doc_id > m),
p as (select distinct doc_id, unnest(range(i, i + 50)) i from c),
words as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from d),
k as (select doc_id, string_agg(x, ' ' order by i) kept, count(*) n from words anti join p using (doc_id, i) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) n_removed, sha256(coalesce(k.kept, '')) kept_sha256
from d left join k using (doc_id)
"""

ORACLE["op3_line_templates"] = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) x, unnest(range(len(string_split(text, chr(10))))) p from documents where text is not null),
w as (select doc_id, p, list_transform(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''), lambda y: case when regexp_matches(y, '[0-9]') then '<*>' else y end) w from l),
o as (select distinct doc_id, w, [len(w)::varchar, w[1], w[2]] leaf from w where len(w) >= 4),
c as (select * from o where leaf in (select leaf from o group by leaf having count(*) >= 10)),
t as (select leaf, unnest(w) token, unnest(range(1, len(w) + 1)) p from c),
k as (select leaf, p, token from t where p > 2 and token <> '<*>' group by all having count(*) >= 10),
d as (select distinct leaf, w from c),
e as (select leaf, w, unnest(w) token, unnest(range(1, len(w) + 1)) p from d),
s as (select e.leaf, e.w, list(case when e.p <= 2 or k.p is not null then e.token else '<*>' end order by e.p) shape
  from e left join k on k.leaf = e.leaf and k.p = e.p and k.token = e.token group by e.leaf, e.w),
m as (select w, shape from s where 5 * len(list_filter(shape, lambda y: y <> '<*>')) >= 3 * len(shape)),
r as (select shape, min(doc_id) first from (select distinct shape, doc_id from c join m using (w)) group by shape having count(*) >= 10),
g as (select doc_id, p from w join m using (w) join r using (shape) where doc_id > first),
a as (select doc_id, count(*) n from l group by doc_id),
kept as (select doc_id, string_agg(x, chr(10) order by p) kept, count(*) n from l anti join g using (doc_id, p) group by doc_id)
select d.doc_id, coalesce(a.n, 0) n_lines, coalesce(a.n, 0) - coalesce(kept.n, 0) n_dropped, sha256(coalesce(kept.kept, '')) kept_sha256
from documents d left join a using (doc_id) left join kept using (doc_id)
"""

ORACLE["op5_quality"] = r"""
with d as (select doc_id, coalesce(text, '') t, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(range(1, len(w) - 3)) i, w from d where len(w) >= 5),
v as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 4], ' ')) n from s),
c as (select doc_id, i - lag(i, 1, -5) over (partition by doc_id order by i) gap from v where n > 1),
rep as (select doc_id, sum(least(5, gap)) n from c group by doc_id),
u as (select doc_id, source, t, unnest(list_filter(list_transform(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) x from d),
f as (select source, x, min(doc_id) m from u group by source, x having count(distinct doc_id) > 30),
gone as (select doc_id, sum(len(string_split(u.x, ' '))) n from u join f on u.source is not distinct from f.source and u.x = f.x where doc_id > m group by doc_id),
b as (select d.doc_id, cast(len(w) as bigint) n_words, length(array_to_string(w, '')) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls,
    coalesce(rep.n, 0) n_repeat_words, coalesce(gone.n, 0) n_removed
  from d left join rep using (doc_id) left join gone using (doc_id))
select doc_id, n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * n_removed <= 70 * n_words kept,
  cast(n_removed as bigint) n_removed
from b
"""

ORACLE["op7_mixture"] = r"""
with d as (select doc_id, source, coalesce('=' || source, 'null') k, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
s as (select k, source, sum(size)::bigint source_size from d group by k, source),
r as (select *, row_number() over (order by source nulls last) n from s),
w as (select *, [5, 2, 1][((n - 1) % 3 + 1)::int]::bigint w, 3 * source_size cap from r),
lv as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / w, n rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over (order by cap::double / w, n rows between current row and unbounded following))::double lev from w),
t as (select k, source_size, least(cap::double, w::double * max(lev) over ()) target from lv),
a as (select *, length(bin(size)) bits, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 4))::bigint % 64 salt from d),
o as (select *, row_number() over (partition by k order by bits * 16 + (size >> greatest(bits - 4, 0)::bigint), salt, size, doc_id nulls first) place from a),
x as (select o.doc_id, o.k, o.size, t.source_size, t.target, o.place,
    case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end rate,
    ('0x' || substr(md5('0:' || o.k), 1, 12))::bigint::double / 281474976710656.0::double base
  from o join t using (k)),
z as (select x.*, j, base + j::double / 64.0::double - floor(base + j::double / 64.0::double) shift from x, range(64) r(j)),
y as (select *, least(floor(place::double * rate + shift) - floor((place - 1)::double * rate + shift), 3)::bigint * size taken from z),
sums as (select k, j, abs(sum(taken)::double - max(target)) miss from y group by k, j),
b as (select k, min({'miss': miss, 'j': j}) best from sums group by k)
select doc_id, size, source_size, target, taken from y join b on b.k = y.k and b.best.j = y.j
"""

ORACLE["op6_quotes"] = r"""
with recursive m as (select conv_id c, turn t, role, coalesce(text, '') x from conversations),
q as (select m.*, p.x x1, o.x x2 from m left join m p on p.c = m.c and p.t = m.t - 1 left join m o on o.c = m.c and o.t = m.t - 2),
l as (select c, t, role, x, case when t % 3 = 0 then case when x2 is not null then [{'l': 1, 'x': x2}] else [] end
    when x1 is null then [] when t % 3 = 2 and x2 is not null then [{'l': 2, 'x': x2}, {'l': 1, 'x': x1}] else [{'l': 1, 'x': x1}] end ps from q),
p as (select c, t, unnest(range(len(ps))) i, unnest(ps) p from l),
z as (select c, t, -1 i, 0 l, x from l union all select c, t, i, p.l, p.x from p),
k as (select c, t, i, l, unnest([{'k': 0, 'x': x}] || list_transform(string_split_regex(x, '\n[ \t\r]*\n'), lambda y: {'k': 1, 'x': y})
    || list_transform(list_filter(string_split(x, chr(10)), lambda y: len(list_filter(string_split_regex(y, '\s+'), lambda w: w <> '')) >= 3), lambda y: {'k': 2, 'x': y})) part from z),
n as (select c, t, i, l, part['k'] kind, lower(trim(regexp_replace(part['x'], '\s+', ' ', 'g'))) x from k),
has as (select c, x, min(t) f from n where i < 0 and x <> '' group by c, x),
b as (select n.c, n.t, n.i, n.l, max({'k': -n.kind, 'f': has.f}) best from n join has on has.c = n.c and has.x = n.x and has.f < n.t where n.i >= 0 group by all),
r as (select c, t, list({'passage': i, 'level': l, 'turn': best.f} order by i) links, max(case when l = 1 then best end) best from b group by c, t),
e as (select l.c, l.t, l.role, l.x, len(l.ps) n_quotes, coalesce(list_max(list_transform(l.ps, lambda y: y.l)), 0) max_level, r.best.f reply_to, coalesce(r.links, []) links from l left join r on r.c = l.c and r.t = l.t),
w as (select c, t, t root, 0 depth, [t] path from e where reply_to is null union all select e.c, e.t, w.root, w.depth + 1, list_append(w.path, e.t) from e join w on e.c = w.c and e.reply_to = w.t)
select e.c conv_id, e.t turn, role, cast(n_quotes as bigint) n_quotes, cast(max_level as integer) max_level, cast(reply_to as bigint) reply_to, cast(root as bigint) root, cast(depth as integer) depth,
  cast(to_json(links) as varchar) quote_links, row_number() over (partition by e.c order by path) - 1 as position, sha256(trim(x, chr(10))) body_sha256
from e join w on w.c = e.c and w.t = e.t
"""
