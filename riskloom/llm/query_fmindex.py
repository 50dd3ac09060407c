"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.fmindex import decontaminate
from riskloom.llm.queries import table


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


QUERIES = {"op4_decontamination": decontamination}
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op4_decontamination": rf"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, w, len(w) as n from (select item_id, {WORDS} as w from benchmark) where len(w) > 0),
windows as (
  select distinct item_id, least(n, 13) as k, list_slice(w, i, i + least(n, 13) - 1) as g
  from (select item_id, w, n, unnest(range(1, greatest(n - 13, 0) + 2)) as i from b)
),
sizes as (select distinct k from windows),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
found as (
  select p.doc_id, p.i, s.k, x.item_id
  from places p cross join sizes s join windows x on x.k = s.k and p.i + s.k - 1 <= len(p.w) and x.g = list_slice(p.w, p.i, p.i + s.k - 1)
),
hits as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + k)) as word from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""
}
