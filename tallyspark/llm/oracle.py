"""The answers in DuckDB SQL where SQL can express them."""

ORACLE: dict[str, str] = {
    "op1_topk": r"""
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op3_near_dedup": r"""
with recursive w as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws
    from documents
), s as (
    select doc_id, case
        when len(ws) = 0 then []
        when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
        end as g
    from w
), u as (
    select doc_id, unnest(g) as sh from s
), common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c
    from u a join u b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), link as (
    select x, y from common join s p on p.doc_id = x join s q on q.doc_id = y
    where 100 * c >= 85 * (len(p.g) + len(q.g) - c)
), both_ways as (
    select x, y from link union all select y, x from link
), reach(doc_id, root) as (
    select doc_id, doc_id from s
    union
    select e.y, r.root from reach r join both_ways e on e.x = r.doc_id
), low as (
    select doc_id, min(root) as component_id from reach group by doc_id
)
select doc_id, len(g) as n_shingles, component_id, doc_id = component_id as kept from s join low using (doc_id)
""",
    "op4_exact_dedup": r"""
with k as (
    select doc_id, coalesce(text, '') as t,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h
    from documents
), g as (
    select doc_id, h, count(*) over (partition by h) as group_size,
           first_value(doc_id) over (partition by h order by length(t) desc, doc_id) as keep_id
    from k
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from g
""",
    "op12_filter_audit": r"""
with t as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), f as (
    select t, min(doc_id) as least from t group by t
), l as (
    select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id
), d as (
    select part,
           case when len(w) < 200 then 'A' else '' end
           || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
           || case when 100 * length(regexp_replace(t.t, '[^A-Z]+', '', 'g')) > 2 * length(t.t) then 'C' else '' end
           || case when regexp_matches(t.t, '[#$%&*|]') then 'D' else '' end
           || case when t.doc_id > f.least then 'E' else '' end as fails,
           coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as bad
    from t join f on t.t = f.t left join l on l.doc_id = t.doc_id
), m as (
    select part, fails, good, bad, count(*) as n from d group by all
), c as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), o as (
    select v.x || w.x || y.x || z.x || u.x as filter_order
    from c v, c w, c y, c z, c u
    where len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5
), s as (
    select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as before
    from o, unnest(range(1, 6)) r(step)
), g as (
    select part, filter_order, step, letter,
           sum(case when not gone and not fails_here then n else 0 end) as kept,
           sum(case when not gone and fails_here then n else 0 end) as removed,
           sum(case when gone and fails_here then n else 0 end) as redundant,
           sum(case when fails = letter then n else 0 end) as unique_fails,
           sum(case when not gone and fails_here and good then n else 0 end) as good_lost,
           sum(case when not gone and fails_here and bad then n else 0 end) as toxic_lost
    from (
        select m.*, s.*, contains(fails, letter) as fails_here, length(translate(fails, before, '')) < length(fails) as gone
        from m, s
    ) group by all
)
select part, filter_order, cast(step as integer) as step, kept::bigint as kept, removed::bigint as removed,
       redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
       toxic_lost::bigint as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from g
""",
}
