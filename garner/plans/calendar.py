"""Guests as people, kinds by raw number, and stored places with validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.kinds import chat_kind, media_kind, message_kind
from garner.functions.text import blank_to_null, is_identifier_like, normalised
from garner.operators.components import connected_components
from garner.session import cut
from garner.sources.tables import table


def name_words(c):
    """Sorted words of a name without punctuation, so that 'Moore, Matthew' and 'Matthew Moore' are one."""
    words = F.filter(F.split(F.regexp_replace(normalised(c), r"[^\p{L}\p{Nd}\s]", ""), r"\s+"), lambda w: w != "")
    return F.array_join(F.sort_array(words), " ")


def guest_people(spark: SparkSession, folder: str) -> DataFrame:
    """Guests' records joined into people through mailboxes and numbers: record and its group.

    An identifier that goes with several names doesn't join records that have a name.
    """
    p = table(spark, folder, "participants", "event_uid", "position", "display_name", "email", "phone_number").distinct()
    record = F.concat_ws(":", "event_uid", F.col("position").cast("string"))
    named = ~is_identifier_like(F.col("display_name"), F.col("email"), F.col("phone_number"))
    rows = p.select(record.alias("node"), F.when(named, blank_to_null(name_words(F.col("display_name")))).alias("name"), F.array(F.lower(blank_to_null(F.col("email"))), F.lower(blank_to_null(F.col("phone_number")))).alias("ids"))
    rows = cut(rows.groupBy("node").agg(F.min("name").alias("name"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")))
    keyed = rows.select("node", "name", F.explode(F.filter("ids", lambda x: x.isNotNull())).alias("id"))
    names = keyed.groupBy("id").agg(F.count_distinct("name").alias("names"))
    joining = keyed.join(names, "id").where("names <= 1 or name is null")
    hub = joining.groupBy("id").agg(F.min("node").alias("b"))
    return connected_components(rows.select("node"), joining.join(hub, "id").where("node <> b").select(F.col("node").alias("a"), "b"))


def raw_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Messages per raw number with the kind and media it stands for."""
    m = table(spark, folder, "chat_messages", "item_type").groupBy(F.coalesce("item_type", F.lit(-1)).alias("raw")).agg(F.count("*").alias("n"))
    return m.select("raw", message_kind(F.col("raw")).alias("kind"), media_kind(F.col("raw")).alias("media"), "n")


def chat_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of each chat by its address and raw number."""
    c = table(spark, folder, "chats", "source_rowid", "jid", "raw_session_type").distinct()
    return c.select("source_rowid", chat_kind(F.col("jid"), F.col("raw_session_type")).alias("shape"))


def event_people(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one mailbox, as organiser or guest: a union of two semi joins, never an OR over both."""
    e = table(spark, folder, "calendar_events", "event_uid", "summary", "organizer_email").distinct()
    g = table(spark, folder, "participants", "event_uid", "email", "is_self")
    wanted = g.where("coalesce(is_self, false) and trim(email) <> ''").select(F.lower("email").alias("m")).distinct()
    guests = g.join(wanted, F.lower("email") == F.col("m"), "left_semi").select("event_uid").distinct()
    led = e.join(wanted, F.lower("organizer_email") == F.col("m"), "left_semi").select("event_uid", F.lit("organiser").alias("role"))
    came = e.join(guests, "event_uid", "left_semi").select("event_uid", F.lit("guest").alias("role"))
    return led.unionByName(came).groupBy("event_uid").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


QUERIES = {f.__name__: f for f in (guest_people, raw_kinds, chat_shapes, event_people)}

SQL = {
    "guest_people": r"""
with recursive r as (
  select distinct event_uid || ':' || cast(position as varchar) as node, display_name, lower(nullif(trim(email), '')) as e, lower(nullif(trim(phone_number), '')) as p from participants),
n as (select node, e, p, case when trim(coalesce(display_name, '')) <> '' and regexp_matches(display_name, '\p{L}') and lower(trim(display_name)) is distinct from e and lower(trim(display_name)) is distinct from p
        then nullif(array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(trim(regexp_replace(display_name, '\s+', ' ', 'g'))), '[^\p{L}\p{Nd}\s]', '', 'g'), '\s+'), lambda w: w <> '')), ' '), '') end as name from r),
m as (select node, min(name) as name from n group by 1),
k as (select distinct n.node, m.name, x.id from (select node, e as id from n union select node, p from n) x join n using (node) join m on m.node = n.node where x.id is not null),
c as (select id, count(distinct name) as names from k group by 1),
j as (select k.node, k.id from k join c using (id) where names <= 1 or name is null),
h as (select id, min(node) as hub from j group by 1),
e as (select distinct j.node as a, h.hub as b from j join h using (id) where j.node <> h.hub), b as (select a, b from e union select b, a from e),
reach(a, b) as (select node, node from m union select reach.a, b.b from reach join b on reach.b = b.a)
select a as node, min(b) as component from reach group by 1""",
    "raw_kinds": """
select coalesce(item_type, -1) as raw, case coalesce(item_type, -1) when 0 then 'text' when 1 then 'image' when 2 then 'video' when 3 then 'audio' when 4 then 'location' when 5 then 'contact' when 6 then 'system' when 7 then 'link'
         when 8 then 'document' when 10 then 'group_event' when 11 then 'gif' when 14 then 'reaction' when 15 then 'sticker' when 59 then 'status_update' else '' end as kind,
       case coalesce(item_type, -1) when 1 then 'image' when 2 then 'video' when 3 then 'audio' when 7 then 'link' when 8 then 'document' when 11 then 'gif' when 15 then 'sticker' else '' end as media, count(*) as n
from chat_messages group by 1""",
    "chat_shapes": """
select distinct source_rowid, case when jid like '%@g.us' then 'group' when contains(jid, '@newsletter') then 'newsletter' when contains(jid, '@status') or coalesce(raw_session_type, 0) = 3 then 'status' else 'dm' end as shape
from (select distinct source_rowid, jid, raw_session_type from chats)""",
    "event_people": """
with w as (select distinct lower(email) as m from participants where coalesce(is_self, false) and trim(email) <> ''),
x as (select event_uid, 'organiser' as role from calendar_events where lower(organizer_email) in (select m from w)
      union select event_uid, 'guest' from calendar_events where event_uid in (select event_uid from participants where lower(email) in (select m from w)))
select event_uid, string_agg(role, ',' order by role) as roles from x group by 1""",
}
