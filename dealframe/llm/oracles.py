"""DuckDB SQL for operators that SQL can express over the shared tables."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

JACCARD = rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w
), n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as root from documents union select u.b, r.root from r join u on u.a = r.node)
select n.doc_id, n.n::bigint as n_shingles, min(r.root) as component_id from n join r on r.node = n.doc_id group by 1, 2
"""

COSINE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as node, vec_id as root from embeddings union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as component_id from r group by 1), k as (select a, count(*) as n from l group by 1)
select m.vec_id, coalesce(k.n, 0)::bigint as n_links, c.component_id, m.vec_id = c.component_id as kept from embeddings m join c on c.node = m.vec_id left join k on k.a = m.vec_id
"""
