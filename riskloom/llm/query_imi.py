"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.imi import hard_negatives
from riskloom.llm.queries import table


def hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


QUERIES = {"op12_hard_negatives": hard_negative_mining}
SQL = {
    "op12_hard_negatives": """
with r as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
),
s as (
  select a.vec_id as anchor_id, a.label as alabel, r.vec_id, r.label,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i]))::bigint as score
  from r a join r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id and len(r.q) = len(a.q)
),
pos as (
  select anchor_id, alabel, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where label = alabel)
  where k <= 5
),
neg as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from pos p join s on s.anchor_id = p.anchor_id and s.label <> p.alabel
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from neg where rank <= 10"""
}
