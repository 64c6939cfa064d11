"""The results of the operators that SQL can express, for DuckDB over the same tables."""

MIX = r"""
with sized as (
  select doc_id, source, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents
),
keyed as (
  select doc_id, source, size,
         greatest(size, 1)::double / (size + 20)
           / (1.0 + abs(length(t)::double / greatest(size, 1) - 6.0) / 6.0) as q,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(t)), 1, 13))::bigint::double
           + 0.5) / 4503599627370496.0 as u
  from sized
),
sources as (
  select source, sum(size)::bigint as source_size,
         [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from keyed group by source
),
levels as (
  select source, source_size, w,
         (1.5 * sum(source_size) over ()
           - coalesce(sum(2.0 * source_size) over (
               order by 2.0 * source_size / w, source nulls last
               rows between unbounded preceding and 1 preceding), 0.0))
         / sum(w) over (order by 2.0 * source_size / w, source nulls last
               rows between current row and unbounded following) as level
  from sources
),
targets as (
  select source, source_size, least(2.0 * source_size, w * max(level) over ()) as target from levels
),
plan as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets
),
ordered as (
  select k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
         sum(k.size) over (partition by k.source order by -ln(k.u) / k.q, k.doc_id, k.size
                           rows between unbounded preceding and current row) - k.size / 2.0 as middle
  from keyed k join plan p on k.source is not distinct from p.source
)
select doc_id, size::bigint as size, source_size, target::double as target,
       (size * (epochs + case when middle <= rest then 1 else 0 end))::bigint as taken
from ordered
"""

_WORDS = r"""list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

DECONTAMINATE = f"""
with d as (
  select doc_id, row_number() over () as row_id, {_WORDS} as ws from documents
),
items as (select item_id, {_WORDS} as ws from benchmark),
windows as (
  select distinct item_id, len(ws[i:i + 9]) as n, array_to_string(ws[i:i + 9], ' ') as w
  from items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as r(i)
  where len(ws) > 0
),
lengths as (select distinct n from windows),
placed as (
  select row_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as w
  from (select row_id, ws, unnest(range(1, len(ws) + 1)) as i from d), lengths
  where i + n - 1 <= len(ws)
),
found as (select row_id, i, n, item_id from placed join windows using (n, w)),
hit as (
  select row_id, count(distinct p) as n_hit
  from found, unnest(range(i, i + n)) as r(p) group by row_id
),
listed as (
  select row_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct row_id, item_id::varchar as item from found where item_id is not null) group by row_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row_id) left join listed using (row_id)
"""

# Exact links over all pairs; the index has to find every one of them to be equal.
MULTI_INDEX = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and list_dot_product(embedding::double[], embedding::double[]) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b
  from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
smallest as (select a, least(a, min(b)) as component_id from reach group by a),
counts as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
       coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join counts c on c.a = vec_id left join smallest s on s.a = vec_id
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: floor(256 * c::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 100 * score between 30 * positive_score and 90 * positive_score
qualify rank <= 10
"""

SQL: dict[str, str] = {
    "op3_source_mix": MIX,
    "op7_decontaminate": DECONTAMINATE,
    "op10_multi_index": MULTI_INDEX,
    "op11_hard_negatives": HARD_NEGATIVES,
}
