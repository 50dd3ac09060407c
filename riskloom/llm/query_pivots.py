"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.pivots import near_duplicates
from riskloom.llm.queries import table


def embedding_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


QUERIES = {"op13_embedding_near_dups": embedding_near_dups}
SQL = {
    "op13_embedding_near_dups": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (
  select vec_id, e from v
  where vec_id is not null and e is not null and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x)))
    and list_sum(list_transform(e, lambda x: x * x)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
),
reach(vec_id, comp) as (select vec_id, vec_id from ok union select l.b, r.comp from reach r join links l on l.a = r.vec_id),
comps as (select vec_id, min(comp) as comp from reach group by vec_id),
counts as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(comp, e.vec_id)::bigint as component_id,
  coalesce(e.vec_id = coalesce(comp, e.vec_id), true) as kept
from embeddings e left join counts using (vec_id) left join comps using (vec_id)"""
}
