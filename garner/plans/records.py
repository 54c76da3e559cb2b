"""Projections, filters and joins over the archive's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import with_utc_ms
from garner.functions.text import blank_to_null, first_shown, human_name, looks_like_phone, shorten
from garner.sources.tables import table

NOW_S = 1_717_200_000  # 2024-06-01T00:00:00Z
APPLE_S = 978_307_200


def chat_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Title of each chat: the first of name, kind with service, and jid that is not blank."""
    chats = table(spark, folder, "chats", "source_rowid", "name", "kind", "service_name", "jid").distinct()
    return chats.select("source_rowid", first_shown(F.col("name"), F.col("jid"), F.col("service_name"), F.col("kind")).alias("title"))


def chat_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Group or direct, by the number of senders other than the owner; a named room is a group."""
    chats = table(spark, folder, "chats", "source_rowid", "name", "kind").distinct()
    senders = table(spark, folder, "chat_messages", "chat_rowid", "handle_rowid").where("handle_rowid <> 0")
    counts = senders.groupBy("chat_rowid").agg(F.count_distinct("handle_rowid").alias("senders"))
    joined = chats.join(counts, chats["source_rowid"] == counts["chat_rowid"], "left")
    n = F.coalesce("senders", F.lit(0))
    group = (n > 1) | (F.col("kind") == "group")
    return joined.select("source_rowid", n.alias("senders"), F.when(group, "group").otherwise("direct").alias("shape"))


def sender_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label of each message's sender: me, display name, handle, or them."""
    messages = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid", "handle_rowid", "is_from_me")
    handles = table(spark, folder, "handles", "source_rowid", "display_name", "handle").distinct()
    joined = messages.join(handles, messages["handle_rowid"] == handles["source_rowid"], "left")
    label = F.when(F.col("is_from_me"), "me").otherwise(F.coalesce(first_shown(F.col("display_name"), F.col("handle")), F.lit("them")))
    return joined.select("message_rowid", "chat_rowid", label.alias("label"))


def peer_names(spark: SparkSession, folder: str) -> DataFrame:
    """Name of each contact that may be shown, by falling preference: full, business, user and first name."""
    c = table(spark, folder, "contacts", "jid", "phone", "full_name", "business_name", "username", "first_name").distinct()
    names = [human_name(F.col(x), F.col("jid"), F.col("phone")) for x in ("full_name", "business_name", "username", "first_name")]
    return c.select("jid", F.coalesce(*names, F.lit("")).alias("shown"), F.coalesce(looks_like_phone(F.col("phone")), F.lit(False)).alias("phone_like"))


def messages_between(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages between two bounds, both inclusive, with their time in seconds."""
    m = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid", "date", "is_from_me")
    # the bounds are turned to the stored unit, so that they reach the scan
    low, high = ((s - APPLE_S) * 10**9 for s in (1_640_995_200, 1_672_531_199))
    return m.where(F.col("date").between(low, high)).select("message_rowid", "chat_rowid", (F.floor(F.col("date") / 10**9).cast("long") + APPLE_S).alias("at_s"), "is_from_me")


def time_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Messages per kind of time: in range, out of range and missing."""
    m = table(spark, folder, "chat_messages", "date")
    bucket = F.when(F.col("date").isNull(), "missing").when(F.col("date") <= 0, "before").when(F.col("date") / 10**9 + APPLE_S > 253402300799, "after").otherwise("valid")
    return m.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def readable_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that are no system record: notices and reactions whose text is machine data are left out."""
    m = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid", "item_type", "associated_message_type", "text")
    system = (F.coalesce("item_type", F.lit(0)) != 0) | (F.coalesce("associated_message_type", F.lit(0)) != 0)
    data = F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False))
    return m.where(~(system & data)).groupBy("chat_rowid").agg(F.count("*").alias("messages"))


def browse_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with a decoded version that are not in the bin: latest title, folder and sighting."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "title", "folder", "text_status", "first_observed_at")
    seen = v.groupBy("note_id").agg(F.max_by(F.struct("title", "folder"), F.struct("first_observed_at", "observation_id")).alias("v"), F.max("first_observed_at").alias("at"))
    decoded = v.where("text_status = 'decoded'").select("note_id").distinct()
    out = seen.join(decoded, "note_id", "left_semi").select("note_id", "v.title", "v.folder", F.unix_seconds("at").alias("at_s"))
    return out.where("folder is distinct from 'Recently Deleted'")


def notes_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose id is the query or whose title begins with it, whatever the case; an exact id comes first."""
    query = "plan"
    v = table(spark, folder, "note_versions", "note_id", "title").distinct()
    hit = v.where(F.lower("title").startswith(query) | (F.col("note_id") == query))
    return hit.select("note_id", "title", (F.col("note_id") == query).alias("exact"))


def open_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose start, in whatever form it is written, lies in the future of the fixed now; cancelled ones too, as their status tells."""
    e = table(spark, folder, "calendar_events", "event_uid", "calendar_title", "start_time", "start_tz", "status").distinct()
    e = with_utc_ms(e, "start_time", "start_tz", "ms").withColumn("start_s", F.floor(F.col("ms") / 1000).cast("long"))
    return e.where(f"start_s >= {NOW_S}").select("event_uid", "calendar_title", "start_s", "status").distinct()


def unread_mails(spark: SparkSession, folder: str) -> DataFrame:
    """Mails per thread whose labels hold UNREAD."""
    m = table(spark, folder, "messages", "id", "thread_id", "labels_json").distinct()
    labels = F.from_json("labels_json", "array<string>")
    unread = F.coalesce(F.array_contains(labels, "UNREAD"), F.lit(False))
    return m.groupBy("thread_id").agg(F.count_distinct("id").alias("mails"), F.count_distinct(F.when(unread, F.col("id"))).alias("unread"))


def message_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with chat title and sender handle; chats and handles that are missing leave nulls."""
    m = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid", "handle_rowid", "date")
    chats = table(spark, folder, "chats", "source_rowid", "name").distinct().select(F.col("source_rowid").alias("c"), F.col("name").alias("chat_name"))
    handles = table(spark, folder, "handles", "source_rowid", "handle").distinct().select(F.col("source_rowid").alias("h"), "handle")
    return m.join(chats, F.col("chat_rowid") == F.col("c"), "left").join(handles, F.col("handle_rowid") == F.col("h"), "left").select("message_rowid", "chat_rowid", F.coalesce("date", F.lit(0)).alias("date"), "chat_name", "handle")


def home_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest chat of each message, with the chat's name, so that no message is counted twice."""
    m = table(spark, folder, "chat_messages", "message_rowid", "chat_rowid").groupBy("message_rowid").agg(F.min("chat_rowid").alias("chat_rowid"))
    chats = table(spark, folder, "chats", "source_rowid", "name").distinct()
    joined = m.join(chats, m["chat_rowid"] == chats["source_rowid"], "left")
    return joined.groupBy("chat_rowid").agg(F.count("*").alias("messages"), F.max(blank_to_null(F.col("name"))).alias("name"))


def contact_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts found by jid, lid, or lid written as a jid: keys are spread out and joined, never compared with OR."""
    c = table(spark, folder, "contacts", "jid", "lid", "full_name").distinct()
    keys = F.array_distinct(F.filter(F.array("jid", "lid", F.concat("lid", F.lit("@lid"))), lambda k: k.isNotNull() & (k != "")))
    keyed = c.select("full_name", F.explode(keys).alias("key"))
    wanted = table(spark, folder, "contacts", "jid").distinct()
    return wanted.join(keyed, wanted["jid"] == keyed["key"]).groupBy("jid").agg(F.count("*").alias("hits"), F.min("full_name").alias("full_name"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with the author of the post they answer; null when it is missing."""
    t = table(spark, folder, "tweets", "id", "author_id", "in_reply_to_id").distinct()
    p = t.select(F.col("id").alias("parent_id"), F.col("author_id").alias("parent_author"))
    return t.where("in_reply_to_id is not null").join(p, F.col("in_reply_to_id") == F.col("parent_id"), "left").select("id", "author_id", "in_reply_to_id", "parent_author")


def ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three ancestors of each reply; a missing one ends the chain with 'unavailable'."""
    t = table(spark, folder, "tweets", "id", "in_reply_to_id").distinct()
    out = t.where("in_reply_to_id is not null").select("id", F.col("in_reply_to_id").alias("a1"))
    for k in (1, 2, 3):
        p = t.select(F.col("id").alias(f"p{k}"), F.col("in_reply_to_id").alias(f"a{k + 1}"))
        out = out.join(p, F.col(f"a{k}") == F.col(f"p{k}"), "left")
    state = F.when(F.col("a1").isNotNull() & F.col("p1").isNull(), "unavailable").when(F.col("a2").isNotNull() & F.col("p2").isNull(), "unavailable").when(F.col("a3").isNotNull() & F.col("p3").isNull(), "unavailable").when(F.col("a4").isNotNull(), "more").otherwise("root")
    return out.select("id", "a1", "a2", "a3", state.alias("ends"))


def with_guests(spark: SparkSession, folder: str) -> DataFrame:
    """Events that have an accepted guest, and events that have no guest at all."""
    e = table(spark, folder, "calendar_events", "event_uid", "summary").groupBy("event_uid").agg(F.min("summary").alias("summary"))
    p = table(spark, folder, "participants", "event_uid", "rsvp_status")
    accepted = e.join(p.where("rsvp_status = 'accepted'"), "event_uid", "left_semi").withColumn("state", F.lit("accepted"))
    alone = e.join(p, "event_uid", "left_anti").withColumn("state", F.lit("alone"))
    return accepted.unionByName(alone)


def account_services(spark: SparkSession, folder: str) -> DataFrame:
    """People per account service, from the JSON map of accounts."""
    p = table(spark, folder, "people", "id", "accounts_json").distinct()
    services = p.select("id", F.explode(F.map_keys(F.from_json("accounts_json", "map<string,array<string>>"))).alias("service"))
    return services.groupBy("service").agg(F.count_distinct("id").alias("people"))


def twin_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user and type within a second of each other, matched when exactly one partner is in reach.

    The tolerance is spread over three whole seconds and joined on equality.
    """
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    right = e.select(F.col("event_id").alias("other"), "user_id", "event_type", F.col("s").alias("other_s"))
    left = e.withColumn("other_s", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
    met = left.join(right, ["user_id", "event_type", "other_s"]).where("event_id <> other")
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.min("other").alias("twin")).where("n = 1").select("event_id", "twin")


def shortened_events(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions cut at 120 characters, and whether they were cut."""
    e = table(spark, folder, "calendar_events", "event_uid", "description").groupBy("event_uid").agg(F.min("description").alias("description"))
    text, was = shorten(F.col("description"), 120)
    return e.select("event_uid", text.alias("shown"), was.alias("was_cut"))


QUERIES = {
    f.__name__: f
    for f in (
        chat_titles, chat_kinds, sender_labels, peer_names, messages_between, time_buckets, readable_messages, browse_notes, notes_by_prefix, open_events, unread_mails,
        message_timeline, home_chats, contact_accounts, replies, ancestors, with_guests, account_services, twin_posts, shortened_events,
    )
}

_BAD = "lower(trim({0})) in ('...', '…', 'unknown') or (regexp_full_match(trim({0}), '[0-9 +().-]+') and length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 5) or not regexp_matches({0}, '\\p{{L}}') or coalesce(lower(trim({0})) = lower(trim(jid)), false) or coalesce(lower(trim({0})) = lower(trim(phone)), false)"
_SHOWN = "case when trim({0}) <> '' and not (" + _BAD + ") then trim({0}) end"

SQL = {
    "chat_titles": "select distinct source_rowid, coalesce(nullif(trim(name), ''), nullif(trim(jid), ''), nullif(trim(service_name), ''), nullif(trim(kind), '')) as title from (select distinct source_rowid, name, kind, service_name, jid from chats)",
    "chat_kinds": """
select c.source_rowid, coalesce(s.senders, 0) as senders,
       case when coalesce(s.senders, 0) > 1 or c.kind = 'group' then 'group' else 'direct' end as shape
from (select distinct source_rowid, name, kind from chats) c
left join (select chat_rowid, count(distinct handle_rowid) as senders from chat_messages where handle_rowid <> 0 group by 1) s
  on c.source_rowid = s.chat_rowid""",
    "sender_labels": """
select m.message_rowid, m.chat_rowid,
       case when m.is_from_me then 'me' else coalesce(nullif(trim(h.display_name), ''), nullif(trim(h.handle), ''), 'them') end as label
from chat_messages m left join (select distinct source_rowid, display_name, handle from handles) h on m.handle_rowid = h.source_rowid""",
    "peer_names": f"""
select jid, coalesce({_SHOWN.format('full_name')}, {_SHOWN.format('business_name')}, {_SHOWN.format('username')}, {_SHOWN.format('first_name')}, '') as shown,
       coalesce(regexp_full_match(phone, '[0-9 +().-]+') and length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 5, false) as phone_like
from (select distinct jid, phone, full_name, business_name, username, first_name from contacts)""",
    "messages_between": """
select message_rowid, chat_rowid, date // 1000000000 + 978307200 as at_s, is_from_me from chat_messages
where date // 1000000000 + 978307200 between 1640995200 and 1672531198 or date = (1672531199 - 978307200) * cast(1000000000 as bigint)""",
    "time_buckets": """
select case when date is null then 'missing' when date <= 0 then 'before' when date / 1e9 + 978307200 > 253402300799 then 'after' else 'valid' end as bucket, count(*) as n
from chat_messages group by 1""",
    "readable_messages": """
select chat_rowid, count(*) as messages from chat_messages
where not ((coalesce(item_type, 0) <> 0 or coalesce(associated_message_type, 0) <> 0) and coalesce(json_valid(text), false)) group by 1""",
    "browse_notes": """
with v as (select note_id, arg_max({'t': title, 'f': folder}, {'a': first_observed_at, 'o': observation_id}) as s, max(first_observed_at) as seen_at,
                  bool_or(text_status = 'decoded') as decoded from note_versions group by 1)
select note_id, s.t as title, s.f as folder, cast(floor(epoch(seen_at)) as bigint) as at_s from v
where decoded and s.f is distinct from 'Recently Deleted'""",
    "notes_by_prefix": "select distinct note_id, title, note_id = 'plan' as exact from note_versions where lower(title) like 'plan%' or note_id = 'plan'",
    "unread_mails": """
select thread_id, count(distinct id) as mails, count(distinct case when list_contains(from_json(labels_json, '["VARCHAR"]'), 'UNREAD') then id end) as unread from messages group by 1""",
    "message_timeline": """
select m.message_rowid, m.chat_rowid, coalesce(m.date, 0) as date, c.name as chat_name, h.handle from chat_messages m
left join (select distinct source_rowid, name from chats) c on m.chat_rowid = c.source_rowid
left join (select distinct source_rowid, handle from handles) h on m.handle_rowid = h.source_rowid""",
    "home_chats": """
with m as (select message_rowid, min(chat_rowid) as chat_rowid from chat_messages group by 1)
select m.chat_rowid, count(*) as messages, max(nullif(trim(c.name), '')) as name
from m left join (select distinct source_rowid, name from chats) c on m.chat_rowid = c.source_rowid group by 1""",
    "contact_accounts": """
with c as (select distinct jid, lid, full_name from contacts), w as (select distinct jid from contacts)
select w.jid, count(*) as hits, min(c.full_name) as full_name from w join c on c.jid = w.jid or c.lid = w.jid or c.lid || '@lid' = w.jid group by 1""",
    "replies": """
with t as (select distinct id, author_id, in_reply_to_id from tweets)
select t.id, t.author_id, t.in_reply_to_id, p.author_id as parent_author from t left join t p on t.in_reply_to_id = p.id where t.in_reply_to_id is not null""",
    "ancestors": """
with t as (select distinct id, in_reply_to_id as up from tweets)
select a.id, a.up as a1, p.up as a2, q.up as a3,
       case when p.id is null then 'unavailable' when p.up is not null and q.id is null then 'unavailable'
            when q.up is not null and r.id is null then 'unavailable' when r.up is not null then 'more' else 'root' end as ends
from t a left join t p on a.up = p.id left join t q on p.up = q.id left join t r on q.up = r.id where a.up is not null""",
    "with_guests": """
with e as (select event_uid, min(summary) as summary from calendar_events group by 1)
select event_uid, summary, 'accepted' as state from e where event_uid in (select event_uid from participants where rsvp_status = 'accepted')
union all select event_uid, summary, 'alone' from e where not exists (select 1 from participants p where p.event_uid = e.event_uid)""",
    "account_services": "select service, count(distinct id) as people from (select id, unnest(json_keys(accounts_json)) as service from people) group by 1",
    "twin_posts": """
with e as (select *, cast(floor(epoch(ts)) as bigint) as s from events)
select a.event_id, min(b.event_id) as twin from e a join e b on a.user_id = b.user_id and a.event_type = b.event_type and b.s between a.s - 1 and a.s + 1 and a.event_id <> b.event_id
group by 1 having count(*) = 1""",
    "shortened_events": "select event_uid, substr(min(description), 1, 120) as shown, length(min(description)) > 120 as was_cut from calendar_events group by 1",
}
