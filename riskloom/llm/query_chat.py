"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.chat import chat_digest, format_chats
from riskloom.llm.queries import table

PROBE = "</s>[INST] ok [/INST]"


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(
        "-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{PROBE}' as text"
    )
    return chat_digest(format_chats(turns.unionByName(probe)))


QUERIES = {"op10_chat_format": chat_format}
SQL = {
    "op10_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), steps as (
  select *, coalesce(lag(role) over w, '^') as before, lead(role) over w as after from turns
  window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(11 + length(role) + length(text)
    + length(regexp_replace(role, '[^<>|\\\\]', '', 'g')) + length(regexp_replace(text, '[^<>|\\\\]', '', 'g'))) as bigint) as formatted_chars,
  bool_and((before || '>' || role) in ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user'))
    and bool_or(after is null and role = 'assistant') as well_formed
from steps group by conv_id"""
}
