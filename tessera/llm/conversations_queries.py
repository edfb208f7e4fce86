"""Problem 2: rebuilding conversations from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.conversations import broken_chats, conversations
from tessera.sources.tables import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_chats(read_table(spark, sf_dir, "ai_chat_messages"))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "ai_chat_messages"))


QUERIES = {f.__name__: f for f in (p2_found, p2_conversations)}

_CTE = r"""
with cur as (select distinct on (id) * from ai_chat_messages order by id, updated_at desc),
msg as (
  select id, nullif(lower(regexp_replace(chat_id, '^\s+|\s+$', '', 'g')), '') as chat_id, content, created_at,
         case lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'ai' then 'assistant' when 'bot' then 'assistant' when 'system' then 'system' when 'tool' then 'tool' end as role,
         deleted_at is null and coalesce(regexp_replace(content, '[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]', '', 'g') <> '', false) as live
  from cur),
said as (select *, lag(role) over w as before, row_number() over (partition by chat_id order by created_at desc) as back, row_number() over w as ord
         from msg where live and role in ('user', 'assistant') window w as (partition by chat_id order by created_at)),
kept as (
  select chat_id from said group by chat_id
  having not bool_or(coalesce(before = role, false)) and max(case when ord = 1 then role end) = 'user' and max(case when back = 1 then role end) = 'assistant'
     and chat_id not in (select chat_id from msg where live and role is null and chat_id is not null))
"""
SQL = {
    "p2_found": _CTE + "select distinct chat_id from msg where chat_id is not null and chat_id not in (select chat_id from kept)",
    "p2_conversations": _CTE + "select chat_id, row_number() over (partition by chat_id order by created_at) as turn, role, content, created_at, id as message_id from msg where live and chat_id in (select chat_id from kept)",
}
