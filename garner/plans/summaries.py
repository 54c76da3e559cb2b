"""Aggregations, windows, limits and set operations over the archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import with_utc_ms
from garner.functions.text import case_quality
from garner.operators.segments import blocks, running
from garner.operators.windows import best_by_rank, context, latest, top_per_source
from garner.sources.decoders import split_addresses
from garner.sources.tables import table

APPLE_S = 978_307_200


def archive_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Live counts of the message archive, each in one pass: messages, chats, senders, earliest and latest valid time."""
    m = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid", "handle_rowid", "date")
    valid = F.when(F.col("date") > 0, F.floor(F.col("date") / 10**9).cast("long") + APPLE_S)
    return m.agg(
        F.count("*").alias("rows_held"),
        F.count_distinct("message_rowid").alias("messages"),
        F.count_distinct("chat_rowid").alias("chats"),
        F.count_distinct(F.when(F.col("handle_rowid") != 0, F.col("handle_rowid"))).alias("senders"),
        F.min(valid).alias("earliest_s"),
        F.max(valid).alias("latest_s"),
    )


def source_status(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct records per source table."""
    parts = [("chat_messages", "message_rowid"), ("messages", "id"), ("tweets", "id"), ("note_versions", "note_id"), ("calendar_events", "event_uid"), ("people", "id"), ("contacts", "jid"), ("handles", "source_rowid")]
    out = None
    for name, key in parts:
        one = table(spark, folder, name, key).agg(F.count("*").alias("rows_held"), F.count_distinct(key).alias("records")).select(F.lit(name).alias("source"), "rows_held", "records")
        out = one if out is None else out.unionByName(one)
    return out


def unread_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Chats, unread chats and unread messages per kind of chat."""
    c = table(spark, folder, "chats", "source_rowid", "kind", "unread_count", "archived").distinct()
    return c.groupBy("kind").agg(
        F.count("*").alias("chats"),
        F.count(F.when(F.col("unread_count") > 0, 1)).alias("unread_chats"),
        F.coalesce(F.sum("unread_count"), F.lit(0)).alias("unread_messages"),
        F.count(F.when(F.col("archived"), 1)).alias("archived"),
    )


def received_by_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct received and own messages per chat, for chats with more than ten."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "is_from_me")
    g = m.groupBy("chat_rowid").agg(
        F.count_distinct("message_rowid").alias("messages"), F.count_distinct(F.when(~F.col("is_from_me"), F.col("message_rowid"))).alias("received")
    )
    return g.where("messages > 10")


def calendar_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Calendars with the number of their events, and of those that are confirmed or all day."""
    e = table(spark, folder, "calendar_events", "event_uid", "calendar_title", "account_name", "status", "all_day").distinct()
    return e.groupBy("calendar_title", "account_name").agg(
        F.count_distinct("event_uid").alias("events"),
        F.count_distinct(F.when(F.col("status") == "confirmed", F.col("event_uid"))).alias("confirmed"),
        F.count_distinct(F.when(F.col("all_day"), F.col("event_uid"))).alias("all_day"),
    )


def folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Notes per folder by their latest sighting, with the newest sighting."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "folder", "first_observed_at")
    last = latest(v, ["note_id"], ["first_observed_at", "observation_id"])
    return last.groupBy("folder").agg(F.count("*").alias("notes"), F.max(F.unix_seconds("first_observed_at")).alias("newest_s"))


def post_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Population and metrics of posts per author: posts, replies, likes with and without a value, extremes."""
    t = latest(table(spark, folder, "tweets", "id", "author_handle", "in_reply_to_id", "like_count", "created_at", "ingested_at"), ["id"], ["ingested_at"])
    return t.groupBy("author_handle").agg(
        F.count("*").alias("posts"),
        F.count("in_reply_to_id").alias("replies"),
        (F.count("*") - F.count("like_count")).alias("unmeasured"),
        F.coalesce(F.sum("like_count"), F.lit(0)).alias("likes"),
        F.coalesce(F.max("like_count"), F.lit(0)).alias("most_likes"),
        F.min(F.unix_seconds("created_at")).alias("first_s"),
        F.max(F.unix_seconds("created_at")).alias("last_s"),
    )


def top_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty posts with most likes, ties by id: a top-k report."""
    t = table(spark, folder, "tweets", "id", "author_handle", "like_count").where("like_count is not null").distinct()
    return t.orderBy(F.desc("like_count"), F.desc("id")).limit(20)


def activity_by_address(spark: SparkSession, folder: str) -> DataFrame:
    """Mail activity of each address as sender, receiver or in copy, over a union of the three roles."""
    m = table(spark, folder, "messages", "id", "from_address", "to_address", "cc_address").distinct()
    parts = [m.select("id", F.explode(split_addresses(F.col(f"{role}_address"))).alias("p"), F.lit(role).alias("role")) for role in ("from", "to", "cc")]
    both = reduce(DataFrame.unionByName, parts).select("id", "role", F.col("p.address").alias("address")).where("address <> ''")
    return both.groupBy("address").agg(F.count_distinct("id").alias("mails"), F.count_distinct(F.when(F.col("role") == "from", F.col("id"))).alias("sent"))


def guests_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct guest names of an event in order, at most three, as one text."""
    p = table(spark, folder, "participants", "event_uid", "display_name").where("trim(display_name) <> ''")
    g = p.groupBy("event_uid").agg(F.sort_array(F.collect_set("display_name")).alias("names"))
    return g.select("event_uid", F.size("names").alias("guests"), F.array_join(F.slice("names", 1, 3), "; ").alias("shown"))


def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Participants per role and answer, the owner apart."""
    p = table(spark, folder, "participants", "event_uid", "position", "role", "rsvp_status", "is_self").distinct()
    return p.groupBy("role", "rsvp_status").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_self"), 1)).alias("own"))


def distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct origins named anywhere, over a union of three tables."""
    parts = [table(spark, folder, n, c).select(F.col(c).alias("origin")) for n, c in (("contact_values", "source"), ("note_versions", "source"), ("tweets", "first_source"))]
    return parts[0].union(parts[1]).union(parts[2]).where("origin is not null").distinct()


def monthly_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Spend in millionths per month and status."""
    o = table(spark, folder, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    micros = F.sum(F.round(F.col("o_totalprice") * 1_000_000).cast("long"))
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(micros.alias("micros"), F.count("*").alias("orders"))


def best_names(spark: SparkSession, folder: str) -> DataFrame:
    """Best spelling of each mail address' name: by use, then case, length and alphabet."""
    m = table(spark, folder, "messages", "from_address", "from_name").where("trim(from_name) <> '' and from_address is not null")
    n = m.groupBy(F.lower("from_address").alias("address"), F.trim("from_name").alias("name")).agg(F.count("*").alias("uses"))
    order = [F.desc("uses"), F.desc(case_quality(F.col("name"))), F.length("name"), F.lower("name"), F.col("name")]
    return best_by_rank(n, ["address"], order).select("address", "name", "uses")


def version_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded sightings with the number of more recent ones of the same note."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "first_observed_at").distinct()
    placed = running(blocks(v, ["note_id"], ["first_observed_at", "observation_id"]), ["note_id"], ["first_observed_at", "observation_id"])
    sizes = v.groupBy("note_id").agg(F.count("*").alias("n"))
    return placed.join(sizes, "note_id").select("note_id", "observation_id", (F.col("n") - F.col("position")).cast("int").alias("more_recent"))


def as_of_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest sighting of each note at a moment."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "first_observed_at", "text_status").where("first_observed_at <= timestamp'2023-01-01 00:00:00'")
    return latest(v, ["note_id"], ["first_observed_at", "observation_id"]).select("note_id", "observation_id", F.unix_seconds("first_observed_at").alias("seen_s"), "text_status")


def message_context(spark: SparkSession, folder: str) -> DataFrame:
    """Two messages before and after each message that has an attachment, in the order of its chat."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "date", "has_attachments")
    m = m.groupBy("chat_rowid", "message_rowid").agg(F.min(F.coalesce("date", F.lit(0))).alias("date"), F.max("has_attachments").alias("has_attachments"))
    out = context(m, ["chat_rowid"], ["date", "message_rowid"], F.coalesce("has_attachments", F.lit(False)), 2, 2)
    return out.select("chat_rowid", "target_place", "offset", "message_rowid", "more_before", "more_after")


def event_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of events with a start, in whatever form it is written: past ones first, newest first, then future ones, soonest first."""
    e = table(spark, folder, "calendar_events", "event_uid", "start_time", "start_tz").distinct()
    keyed = with_utc_ms(e, "start_time", "start_tz", "ms").withColumn("s", F.floor(F.col("ms") / 1000).cast("long")).where("s is not null").withColumn("sort_key", F.when(F.col("s") < 1_717_200_000, -F.col("s")).otherwise(F.col("s")))
    return keyed.select("event_uid", "sort_key").distinct()


def newest_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty newest records over three sources: top-k per source, then over all; ties by key."""
    tweets = table(spark, folder, "tweets", "id", "created_at").distinct().select(F.lit("tweets").alias("source"), F.col("id").alias("key"), F.unix_seconds("created_at").alias("at_s"))
    notes = table(spark, folder, "note_versions", "observation_id", "first_observed_at").distinct()
    notes = notes.select(F.lit("notes").alias("source"), F.col("observation_id").cast("string").alias("key"), F.unix_seconds("first_observed_at").alias("at_s"))
    chats = table(spark, folder, "chat_messages", "message_rowid", "date").where("date > 0").distinct()
    chats = chats.select(F.lit("chats").alias("source"), F.col("message_rowid").cast("string").alias("key"), (F.floor(F.col("date") / 10**9).cast("long") + APPLE_S).alias("at_s"))
    return top_per_source([tweets, notes, chats], [F.desc_nulls_last("at_s"), F.col("source"), F.col("key")], 50)


def probed_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per word with a probe of one row beyond the limit: a total that is a lower bound is marked."""
    t = table(spark, folder, "tweets", "id", "text").distinct()
    limit = 20
    out = None
    for word in ("harbour", "weather", "zebra"):
        hit = t.where(F.lower("text").contains(word)).limit(limit + 1).agg(F.count("*").alias("n"))
        one = hit.select(F.lit(word).alias("word"), F.least("n", F.lit(limit + 1)).alias("total"), (F.col("n") > limit).alias("lower_bound"))
        out = one if out is None else out.unionByName(one)
    return out


def people_union(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct folded names over people, contacts and handles, and the tables each occurs in."""
    parts = [table(spark, folder, n, c).select(F.lit(n).alias("source"), F.lower(F.trim(c)).alias("name")) for n, c in (("people", "name"), ("contacts", "full_name"), ("handles", "display_name"))]
    rows = parts[0].union(parts[1]).union(parts[2]).where("name <> ''").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("tables"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def names_in_one_table(spark: SparkSession, folder: str) -> DataFrame:
    """Names in people that are in contacts too, and names in people that are in neither other table."""
    names = {n: table(spark, folder, n, c).select(F.lower(F.trim(c)).alias("name")).where("name <> ''").distinct() for n, c in (("people", "name"), ("contacts", "full_name"), ("handles", "display_name"))}
    both = names["people"].intersect(names["contacts"]).withColumn("kind", F.lit("both"))
    alone = names["people"].subtract(names["contacts"]).subtract(names["handles"]).withColumn("kind", F.lit("alone"))
    return both.unionByName(alone)


def rolling_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events per thirty days and type, with distinct users and the sum of values."""
    e = table(spark, folder, "events", "ts", "user_id", "event_type", "value")
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (30 * 86400)).cast("long")
    return e.groupBy(bucket.alias("period"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        archive_counts, source_status, unread_by_kind, received_by_chat, calendar_catalogue, folder_counts, post_stats, top_posts, activity_by_address, guests_listed, role_counts,
        distinct_sources, monthly_spend, best_names, version_ordinals, as_of_versions, message_context, event_order, newest_matches, probed_totals, people_union, names_in_one_table, rolling_activity,
    )
}

_QUALITY = "case when regexp_matches(name, '\\p{Lu}') and regexp_matches(name, '\\p{Ll}') then 2 when regexp_matches(name, '\\p{Ll}') then 1 else 0 end"

_PARTS = """regexp_extract_all({0}, '(?:"[^"]*"|[^",])+')"""

SQL = {
    "archive_counts": """
select count(*) as rows_held, count(distinct message_rowid) as messages, count(distinct chat_rowid) as chats,
       count(distinct case when handle_rowid <> 0 then handle_rowid end) as senders,
       min(case when date > 0 then date // 1000000000 + 978307200 end) as earliest_s, max(case when date > 0 then date // 1000000000 + 978307200 end) as latest_s
from chat_messages""",
    "source_status": " union all ".join(
        f"select '{n}' as source, count(*) as rows_held, count(distinct {k}) as records from {n}"
        for n, k in (("chat_messages", "message_rowid"), ("messages", "id"), ("tweets", "id"), ("note_versions", "note_id"), ("calendar_events", "event_uid"), ("people", "id"), ("contacts", "jid"), ("handles", "source_rowid"))
    ),
    "unread_by_kind": """
select kind, count(*) as chats, count(*) filter (unread_count > 0) as unread_chats, cast(coalesce(sum(unread_count), 0) as bigint) as unread_messages, count(*) filter (archived) as archived
from (select distinct source_rowid, kind, unread_count, archived from chats) group by 1""",
    "received_by_chat": """
select chat_rowid, count(distinct message_rowid) as messages, count(distinct case when not is_from_me then message_rowid end) as received
from chat_messages group by 1 having count(distinct message_rowid) > 10""",
    "calendar_catalogue": """
select calendar_title, account_name, count(distinct event_uid) as events, count(distinct case when status = 'confirmed' then event_uid end) as confirmed,
       count(distinct case when all_day then event_uid end) as all_day from calendar_events group by 1, 2""",
    "folder_counts": """
with l as (select note_id, arg_max({'f': folder}, {'a': first_observed_at, 'o': observation_id}) as v, max(first_observed_at) as t from note_versions group by 1)
select v.f as folder, count(*) as notes, cast(max(floor(epoch(t))) as bigint) as newest_s from l group by 1""",
    "post_stats": """
with t as (select id, arg_max({'h': author_handle, 'r': in_reply_to_id, 'l': like_count, 'c': created_at}, ingested_at) as v from tweets group by 1)
select v.h as author_handle, count(*) as posts, count(v.r) as replies, count(*) - count(v.l) as unmeasured, cast(coalesce(sum(v.l), 0) as bigint) as likes,
       coalesce(max(v.l), 0) as most_likes, cast(min(floor(epoch(v.c))) as bigint) as first_s, cast(max(floor(epoch(v.c))) as bigint) as last_s from t group by 1""",
    "top_posts": "select distinct id, author_handle, like_count from tweets where like_count is not null order by like_count desc, id desc limit 20",
    "activity_by_address": f"""
with m as (select distinct id, from_address, to_address, cc_address from messages),
b as (select id, unnest({_PARTS.format('from_address')}) as p, 'from' as role from m union all select id, unnest({_PARTS.format('to_address')}), 'to' from m union all select id, unnest({_PARTS.format('cc_address')}), 'cc' from m),
a as (select id, role, lower(case when regexp_extract(p, '<\\s*([^<>]*?)\\s*>', 1) <> '' then regexp_extract(p, '<\\s*([^<>]*?)\\s*>', 1) else trim(p) end) as address from b)
select address, count(distinct id) as mails, count(distinct case when role = 'from' then id end) as sent from a where address <> '' group by 1""",
    "guests_listed": """
select event_uid, len(n) as guests, array_to_string(n[1:3], '; ') as shown
from (select event_uid, list_sort(list(distinct display_name)) as n from participants where trim(display_name) <> '' group by 1)""",
    "role_counts": """
select role, rsvp_status, count(*) as n, count(*) filter (is_self) as own from (select distinct event_uid, position, role, rsvp_status, is_self from participants) group by 1, 2""",
    "distinct_sources": "select source as origin from contact_values where source is not null union select source from note_versions where source is not null union select first_source from tweets where first_source is not null",
    "monthly_spend": "select strftime(o_orderdate, '%Y-%m') as month, o_orderstatus, cast(sum(cast(round(o_totalprice * 1000000) as bigint)) as bigint) as micros, count(*) as orders from orders group by 1, 2",
    "best_names": f"""
select address, name, uses from (
  select *, row_number() over (partition by address order by uses desc, {_QUALITY} desc, length(name), lower(name), name) as n
  from (select lower(from_address) as address, trim(from_name) as name, count(*) as uses from messages where trim(from_name) <> '' and from_address is not null group by 1, 2))
where n = 1""",
    "version_ordinals": """
select note_id, observation_id, cast(row_number() over (partition by note_id order by first_observed_at desc, observation_id desc) - 1 as integer) as more_recent
from (select distinct note_id, observation_id, first_observed_at from note_versions)""",
    "as_of_versions": """
select note_id, v.o as observation_id, cast(floor(epoch(t)) as bigint) as seen_s, v.s as text_status from (
  select note_id, arg_max({'o': observation_id, 's': text_status}, {'a': first_observed_at, 'o': observation_id}) as v, max(first_observed_at) as t
  from note_versions where first_observed_at <= timestamptz '2023-01-01 00:00:00+00' group by 1)""",
    "message_context": """
with m as (select chat_rowid, message_rowid, min(coalesce(date, 0)) as date, bool_or(has_attachments) as hit from chat_messages group by 1, 2),
p as (select *, row_number() over (partition by chat_rowid order by date, message_rowid) as place, count(*) over (partition by chat_rowid) as size from m)
select p.chat_rowid, h.place as target_place, p.place - h.place as offset, p.message_rowid, h.place - 2 > 1 as more_before, h.place + 2 < h.size as more_after
from p join p h on p.chat_rowid = h.chat_rowid and p.place between h.place - 2 and h.place + 2 where h.hit""",
    "newest_matches": """
select * from (
  select distinct 'tweets' as source, id as key, cast(floor(epoch(created_at)) as bigint) as at_s from tweets
  union all select distinct 'notes', cast(observation_id as varchar), cast(floor(epoch(first_observed_at)) as bigint) from note_versions
  union all select distinct 'chats', cast(message_rowid as varchar), date // 1000000000 + 978307200 from chat_messages where date > 0)
order by at_s desc nulls last, source, key limit 50""",
    "probed_totals": """
select w as word, least(n, 21) as total, n > 20 as lower_bound from (
  select w, count(distinct id) as n from (values ('harbour'), ('weather'), ('zebra')) v(w) left join (select distinct id, text from tweets) t on contains(lower(t.text), w) group by 1)""",
    "people_union": """
select name, count(*) as tables, string_agg(source, ',' order by source) as sources from (
  select distinct 'people' as source, lower(trim(name)) as name from people union select 'contacts', lower(trim(full_name)) from contacts union select 'handles', lower(trim(display_name)) from handles)
where name <> '' group by 1""",
    "names_in_one_table": """
with p as (select distinct lower(trim(name)) as name from people where trim(name) <> ''), c as (select lower(trim(full_name)) as name from contacts where trim(full_name) <> ''),
h as (select lower(trim(display_name)) as name from handles where trim(display_name) <> '')
select name, 'both' as kind from (select name from p intersect select name from c)
union all select name, 'alone' from (select name from p except select name from c except select name from h)""",
    "rolling_activity": """
select cast(floor(floor(epoch(ts)) / 2592000) as bigint) as period, event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1, 2""",
}
