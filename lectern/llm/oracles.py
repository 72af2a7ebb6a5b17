"""DuckDB SQL for the queries that SQL can express, over the same tables (doc_id and vec_id are unique there)."""

TOP_K = """
with v as (select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""

WORD_REPEATS = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
twice as (select s from p group by s having count(*) > 1),
gone as (select distinct doc_id, i + k as pos from p join twice using (s), (select unnest(range(35)) as k)),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
l as (select x.doc_id, string_agg(word, ' ' order by pos) as kept from x anti join gone using (doc_id, pos) group by x.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(l.kept, '')) as kept_sha256 from d left join n using (doc_id) left join l using (doc_id)
"""

BYTE_REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i, md5(substring(h, 2 * i + 1, 200)) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from d where len(h) >= 200)),
f as (select s, min({'d': doc_id, 'i': i}) as f from p group by s having count(*) > 1),
g as (select doc_id, i as a, i + 100 as b from p join f using (s) where f.f < {'d': doc_id, 'i': i}),
r as (select *, max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) as reach from g),
k as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by doc_id order by a rows unbounded preceding) as run from r),
m as (select doc_id, min(a) as a, max(b) as b from k group by doc_id, run),
n as (select doc_id, sum(b - a) as n, count(*) as runs from m group by doc_id),
e as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from m union all select doc_id, max(b), null from m group by doc_id),
l as (select d.doc_id, string_agg(substring(h, 2 * e.a + 1, case when e.b is null then len(h) else 2 * (e.b - e.a) end), '' order by e.a) as h from d join e using (doc_id) group by d.doc_id)
select d.doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(n.n, 0) as bigint) as n_removed, coalesce(n.runs, 0) as n_spans, sha256(unhex(case when n.n is null then d.h else coalesce(l.h, '') end)) as kept_sha256
from d left join n using (doc_id) left join l using (doc_id)
"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select part, if(len(w) < 50, 'A', '') || if(100 * len(list_distinct(w)) < 65 * len(w), 'B', '') || if(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'C', '')
    || if(regexp_matches(text, '[#$%&*|]'), 'D', '') || if(min(doc_id) over (partition by text) < doc_id, 'E', '') as mask,
  coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic from d left join labels l using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as o from f a, f b, f c, f d, f e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o as filter_order, step, o[step] as letter, o[1:step - 1] as before from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, step, letter,
  coalesce(sum(n) filter (translate(mask, before || letter, '') = mask), 0) as kept,
  coalesce(sum(n) filter (contains(mask, letter) and translate(mask, before, '') = mask), 0) as removed,
  coalesce(sum(n) filter (contains(mask, letter) and translate(mask, before, '') <> mask), 0) as redundant,
  coalesce(sum(n) filter (mask = letter), 0) as unique_fails,
  coalesce(sum(good) filter (contains(mask, letter) and translate(mask, before, '') = mask), 0) as good_lost,
  coalesce(sum(toxic) filter (contains(mask, letter) and translate(mask, before, '') = mask), 0) as toxic_lost
  from c, s group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from r
"""

EXACT_GROUPS = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
