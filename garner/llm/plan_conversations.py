"""Conversations of chats, mails and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import with_utc_ms
from garner.llm.conversations import REPLY_MARK, has_text, kahn_order, keep_whole, number_turns, reply_faults
from garner.sources.tables import table


def _chats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "handle_rowid", "date", "is_from_me", "text", "item_type", "associated_message_type")
    rows = rows.where(has_text("text") & (F.coalesce("item_type", F.lit(0)) == 0) & (F.coalesce("associated_message_type", F.lit(0)) == 0))
    rows = rows.where("chat_rowid is not null and message_rowid is not null")
    owner = F.coalesce("is_from_me", F.lit(False)) | (F.coalesce("handle_rowid", F.lit(-1)) == 0)
    speaker = F.when(owner, "0").otherwise(F.col("handle_rowid").cast("string"))
    one = rows.groupBy("message_rowid").agg(F.min(F.struct("chat_rowid", "date", speaker.alias("speaker"))).alias("v"))
    return one.select(
        F.lit("chat_messages").alias("source"),
        F.col("v.chat_rowid").cast("string").alias("conversation"),
        F.col("message_rowid").cast("string").alias("message"),
        F.col("message_rowid").alias("place"),
        "v.speaker",
        F.col("v.date").alias("at"),
        (F.coalesce(F.col("v.date"), F.lit(0)) <= 0).alias("broken"),
    )


def _mails(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages", "id", "thread_id", "internal_date_ms", "from_address", "subject", "body")
    rows = rows.where(has_text("body") & F.col("id").isNotNull() & F.col("thread_id").isNotNull())
    rows = with_utc_ms(rows, "internal_date_ms", None, "at").withColumn("at", F.when(F.col("internal_date_ms") > 0, F.col("at")))
    value = F.struct("thread_id", "at", F.lower(F.trim("from_address")).alias("speaker"), F.coalesce(F.col("subject").rlike(REPLY_MARK), F.lit(False)).alias("marked"))
    one = rows.groupBy("id").agg(F.min(value).alias("v")).select("id", "v.*")
    first = one.groupBy("thread_id").agg(F.min(F.struct("at", "id", "marked")).alias("first"))
    headless = first.where("first.marked").select(F.lit("messages").alias("source"), F.col("thread_id").alias("conversation"))
    made = one.select(
        F.lit("messages").alias("source"),
        F.col("thread_id").alias("conversation"),
        F.col("id").alias("message"),
        F.lit(0).cast("long").alias("place"),
        "speaker",
        "at",
        F.col("at").isNull().alias("broken"),
    )
    return made, headless


def _posts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "tweets", "id", "created_at", "author_id", "text", "in_reply_to_id", "conversation_id")
    rows = rows.where(has_text("text") & F.col("id").isNotNull())
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    value = F.struct(F.coalesce(blank("conversation_id"), F.col("id")).alias("conversation"), "created_at", F.col("author_id").alias("speaker"), blank("in_reply_to_id").alias("parent"))
    one = rows.groupBy("id").agg(F.min(value).alias("v")).select("id", "v.*")
    made = one.select(
        F.lit("tweets").alias("source"),
        "conversation",
        F.col("id").alias("message"),
        F.lit(0).cast("long").alias("place"),
        "speaker",
        F.unix_micros("created_at").alias("at"),
        F.lit(False).alias("broken"),
        "parent",
    )
    rooted = one.groupBy("conversation").agg(F.max(F.col("id") == F.col("conversation")).alias("rooted"))
    faults = reply_faults(made).unionByName(rooted.where("not rooted").select("conversation"))
    return made, faults.select(F.lit("tweets").alias("source"), "conversation")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of every whole conversation in chats, mails and posts."""
    mails, headless = _mails(spark, folder)
    posts, faults = _posts(spark, folder)
    rows = _chats(spark, folder).unionByName(mails).unionByName(posts.drop("parent"))
    kept = keep_whole(rows, headless.unionByName(faults)).select("source", "conversation", "at", "place", "message")
    turns = number_turns(kept, ["at", "place", "message"])
    return turns.select("source", F.col("conversation").alias("conversation_key"), F.col("turn_no").cast("int").alias("turn_no"), F.col("message").alias("message_key"))


def p3_reply_order(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of every whole conversation in the order of Kahn's algorithm: no reply comes before what it answers, whatever its time."""
    posts, faults = _posts(spark, folder)
    kept = keep_whole(posts, faults)
    turns = number_turns(kahn_order(kept), ["order"])
    return turns.select(F.col("conversation").alias("conversation_key"), F.col("turn_no").cast("int").alias("turn_no"), F.col("message").alias("message_key"))


QUERIES = {"p3_found": p3_found, "p3_reply_order": p3_reply_order}

SQL = {
    "p3_found": r"""
with chat as (
  select message_rowid, min(chat_rowid) as chat_rowid, min(date) as ts,
         min(case when is_from_me or handle_rowid = 0 then '0' else cast(handle_rowid as varchar) end) as speaker
  from chat_messages
  where regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FFFC}]', '', 'g') <> ''
    and coalesce(item_type, 0) = 0 and coalesce(associated_message_type, 0) = 0
  group by 1),
mail as (
  select id, min(thread_id) as thread_id, min(lower(trim(from_address))) as speaker, min(subject) as subject,
         min(case when internal_date_ms between 1451606400 and 1830297599 then internal_date_ms * 1000
              when internal_date_ms between 1451606400000 and 1830297599999 then internal_date_ms
              when internal_date_ms between 1451606400000000 and 1830297599999999 then internal_date_ms // 1000
              when internal_date_ms between 1451606400000000000 and 1830297599999999999 then internal_date_ms // 1000000
              when internal_date_ms between 473299200 and 851990399 then (internal_date_ms + 978307200) * 1000
              when internal_date_ms between 473299200000000000 and 851990399999999999
                then internal_date_ms // 1000000 + 978307200000 end) as ts
  from messages
  where regexp_replace(body, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FFFC}]', '', 'g') <> ''
  group by 1),
headed as (
  select thread_id, arg_min(subject, (ts, id)) as subject from mail where ts is not null group by 1),
post as (
  select id, min(coalesce(nullif(trim(conversation_id), ''), id)) as conv, min(epoch_us(created_at)) as ts,
         min(author_id) as speaker, min(nullif(trim(in_reply_to_id), '')) as parent
  from tweets
  where regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FFFC}]', '', 'g') <> ''
  group by 1),
alls as (
  select 'chat_messages' as source, cast(chat_rowid as varchar) as conv, cast(message_rowid as varchar) as k,
         message_rowid as place, speaker, ts, coalesce(ts, 0) <= 0 as bad from chat
  union all
  select 'messages', m.thread_id, m.id, 0, m.speaker, m.ts,
         m.ts is null or coalesce(regexp_matches(h.subject, '^\s*(re|aw|sv|antw)\s*(\[\s*\d+\s*\])?\s*:', 'i'), false)
  from mail m left join headed h using (thread_id)
  union all
  select 'tweets', c.conv, c.id, 0, c.speaker, c.ts,
         (c.parent is not null and p.id is null) or not exists (select 1 from post r where r.id = c.conv and r.conv = c.conv)
  from post c left join post p on c.parent = p.id and c.conv = p.conv),
kept as (
  select source, conv from alls group by 1, 2 having count(distinct speaker) >= 2 and not bool_or(bad))
select source, conv as conversation_key,
       cast(row_number() over (partition by source, conv order by ts, place, k) as integer) as turn_no, k as message_key
from alls join kept using (source, conv)""",
}
