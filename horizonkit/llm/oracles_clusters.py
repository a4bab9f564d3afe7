"""DuckDB twin of the centroid clustering query."""

from __future__ import annotations

from horizonkit.llm.bit_plane_clusters import CLUSTERS, COMPONENTS, ROUNDS, SCALE, SEED


def _assign(name: str, centroids: str) -> str:
    distance = f"list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::bigint"
    return f"""{name} as materialized (
    select r, any_value(vec_id) as vec_id, any_value(q) as q, arg_min(k, (d, k)) as k, min(d) as d
    from (select v.r, v.vec_id, v.q, {centroids}.k, {distance} as d from v, {centroids}) group by r)"""


def _move(name: str, assigned: str, before: str) -> str:
    return f"""{name} as materialized (
    select b.k, coalesce(m.c, b.c) as c from {before} b left join (
        select k, list(m order by i) as c from (
            select k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
            from (select k, unnest(q) as x, unnest(range({COMPONENTS})) as i from {assigned}) group by k, i)
        group by k) m on b.k = m.k)"""


def centroid_clusters() -> str:
    steps = [f"""v as materialized (
    select row_number() over () as r, vec_id,
           list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
    from embeddings
    where len(embedding) = {COMPONENTS}
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {COMPONENTS})""",
             f"""c0 as materialized (
    select row_number() over (order by h, q) - 1 as k, q as c
    from (select sha256('{SEED}:' || vec_id) as h, q from v where vec_id is not null order by h, q limit {CLUSTERS}))"""]
    for n in range(ROUNDS):
        steps += [_assign(f"a{n}", f"c{n}"), _move(f"c{n + 1}", f"a{n}", f"c{n}")]
    steps.append(_assign("a", f"c{ROUNDS}"))
    return f"""with {', '.join(steps)}
select vec_id, a.k::int as "cluster", d as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a join c{ROUNDS} c on a.k = c.k"""
