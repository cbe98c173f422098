"""Query and SQL of the centroid clustering; the SQL measures every pair of vector and centroid."""

from __future__ import annotations

from tallyward.llm import centroids
from tallyward.sources.tables import load

NAME = "op11_centroid_clustering"
SIZE, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2


def query(spark, folder):
    return centroids.clustered(load(spark, folder, "embeddings"), size=SIZE, k=K, rounds=ROUNDS, scale=SCALE, salt=SALT)


def _assigned(centres: str) -> str:
    """Every vector with its nearest centroid of the relation ``centres`` (cluster, c)."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    return f"""
        select rid, vec_id, v, cluster, distance from (select rid, vec_id, v, cluster, {apart} as distance from kept, {centres})
        qualify row_number() over (partition by rid order by distance, cluster) = 1"""


def _round(i: int) -> str:
    """The floor of the mean; a remainder below zero is brought above it first."""
    return f"""
    at{i} as materialized ({_assigned(f"c{i}")}),
    m{i} as materialized (
        select cluster, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as c
        from (select cluster, i, sum(x)::hugeint as s, count(*)::hugeint as n
              from (select cluster, unnest(v) as x, unnest(range({SIZE})) as i from at{i}) group by cluster, i)
        group by cluster),
    c{i + 1} as materialized (select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))"""


SQL = f"""
with kept as materialized (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
    from embeddings
    where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE}),
c0 as materialized (
    select (row_number() over (order by d, v) - 1)::int as cluster, v as c
    from (select v, sha256('{SALT}:' || coalesce(vec_id::varchar, '')) as d from kept) order by d, v limit {K}),
{", ".join(_round(i) for i in range(ROUNDS))},
last as materialized ({_assigned(f"c{ROUNDS}")})
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from last join c{ROUNDS} using (cluster)"""
