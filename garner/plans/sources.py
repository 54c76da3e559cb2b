"""Who takes part where, per source; what is left to do; and checks of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.matching import match_rank
from garner.functions.text import blank_to_null, first_shown, human_name, mail_key, phone_key
from garner.operators.identity import ambiguous_keys, repaired_groups, unique_match
from garner.operators.ingest import capped_claims, changed_since, refresh_or_insert, work_queue
from garner.operators.windows import latest
from garner.plans.conversations import _PHONE
from garner.plans.people import contact_keys
from garner.sources.tables import table

QUESTION = "ja"


def owner_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Own messages per chat with the owner's mailbox, which is one row beside all of them."""
    owner = table(spark, folder, "participants", "email", "is_self").where("is_self and trim(email) <> ''").agg(F.min(mail_key(F.col("email"))).alias("owner"))
    own = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "is_from_me").where("is_from_me").groupBy("chat_rowid").agg(F.count_distinct("message_rowid").alias("messages"))
    return own.join(F.broadcast(owner))  # one row, as it is an aggregate without keys


def chat_participant_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone who writes in a chat: the handle without outer blanks, else the name, in the order of the handle."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "handle_rowid").where("handle_rowid <> 0 and chat_rowid is not null").distinct()
    h = table(spark, folder, "handles", "source_rowid", "handle", "display_name").select("source_rowid", first_shown(F.col("handle"), F.col("display_name")).alias("identity")).where("identity is not null").distinct()
    return m.join(h, m["handle_rowid"] == h["source_rowid"]).groupBy("chat_rowid").agg(F.array_join(F.array_sort(F.collect_set("identity")), ", ").alias("identities"))


def group_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct authors seen in each chat that is a group, and the owner's own part in it."""
    groups = table(spark, folder, "chats", "source_rowid", "kind").where("kind = 'group'").select(F.col("source_rowid").alias("chat_rowid")).distinct()
    m = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "handle_rowid", "is_from_me").join(groups, "chat_rowid", "left_semi")
    return m.groupBy("chat_rowid").agg(F.count_distinct(F.when(F.col("handle_rowid") != 0, F.col("handle_rowid"))).alias("authors"), F.count_distinct(F.when(F.col("is_from_me"), F.col("message_rowid"))).alias("own"))


def messages_by_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each wanted message exists, looked up by key alone: those that posts' numbers name."""
    wanted = table(spark, folder, "tweets", "like_count").where("like_count is not null").select(F.col("like_count").alias("message_rowid")).distinct()
    there = table(spark, folder, "chat_messages", "message_rowid").distinct().withColumn("found", F.lit(True))
    return wanted.join(there, "message_rowid", "left").select("message_rowid", F.coalesce("found", F.lit(False)).alias("found"))


def clean_identity(c: Column) -> Column:
    """An identity without format characters, repeated blanks and repeated ``@lid`` endings."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), r"\s+", " "))
    return F.regexp_replace(bare, r"(@lid)(?:@lid)+$", "$1")


def clean_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts' addresses and names in clean form."""
    c = table(spark, folder, "contacts", "jid", "full_name").distinct()
    return c.select("jid", clean_identity(F.col("jid")).alias("identity"), F.coalesce(clean_identity(F.col("full_name")), F.lit("")).alias("name"))


_NAMES = ("full_name", "business_name", "username", "first_name", "last_name")
_IDS = ("jid", "phone", "lid", "username")


def contact_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """(jid, kind, alias): every name and identifier of a contact, over a union of one branch per field."""
    c = table(spark, folder, "contacts", "jid", "full_name", "business_name", "username", "first_name", "last_name", "phone", "lid").distinct()
    names = [F.struct(F.lit("name").alias("kind"), F.trim(x).alias("alias")) for x in _NAMES]
    both = F.struct(F.lit("name").alias("kind"), F.trim(F.concat_ws(" ", F.trim("first_name"), F.trim("last_name"))).alias("alias"))
    ids = [F.struct(F.lit("identifier").alias("kind"), F.trim(x).alias("alias")) for x in _IDS]
    return c.select("jid", F.explode(F.array(*names, both, *ids)).alias("a")).select("jid", "a.*").where("alias <> ''").distinct()


def contact_who(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts who fit the question: best rank over their names, and the name they go by; direct fits hide close spellings."""
    a = contact_aliases(spark, folder).where("kind = 'name'").withColumn("rank", match_rank(F.lit(QUESTION), F.col("alias"))).where("rank is not null")
    who = a.groupBy("jid").agg(F.max("rank").alias("rank"))
    c = table(spark, folder, "contacts", "jid", "full_name", "business_name", "username", "phone").distinct()
    shown = c.select("jid", *[human_name(F.col(x), F.col("jid"), F.col("phone")).alias(x) for x in ("full_name", "business_name", "username")])
    name = shown.groupBy("jid").agg(*[F.min(x).alias(x) for x in ("full_name", "business_name", "username")]).select("jid", F.coalesce("full_name", "business_name", "username", F.lit("")).alias("name"))
    top = who.agg(F.max("rank").alias("top"))
    return who.join(F.broadcast(top)).where("rank > 1 or top = 1").join(name, "jid").select("jid", "name", "rank")


def post_people(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone who takes part in a conversation of posts: authors, those answered, and those named, with their roles."""
    t = table(spark, folder, "tweets", "id", "conversation_id", "author_handle", "in_reply_to_id", "text").withColumn("talk", F.coalesce(blank_to_null(F.col("conversation_id")), F.col("id")))
    author = t.select("talk", F.lower("author_handle").alias("handle"), F.lit("author").alias("role"))
    parents = t.select(F.col("id").alias("in_reply_to_id"), F.lower("author_handle").alias("handle")).distinct()
    answered = t.where("trim(in_reply_to_id) <> ''").join(parents, "in_reply_to_id").select("talk", "handle", F.lit("answered").alias("role"))
    named = t.select("talk", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_@.])@([A-Za-z0-9_]+)"), F.lit(1))).alias("handle")).select("talk", F.lower("handle").alias("handle"), F.lit("named").alias("role"))
    every = author.unionByName(answered).unionByName(named).where("handle <> ''")
    return every.groupBy("talk", "handle").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def exact_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Whom each handle's identifier names exactly: its one person, or the owner, or nobody, or several."""
    h = table(spark, folder, "handles", "source_rowid", "handle").where("trim(handle) <> ''").distinct()
    mail = F.col("handle").contains("@")
    h = h.select("source_rowid", F.when(mail, mail_key(F.col("handle"))).otherwise(phone_key(F.col("handle"))).alias("value")).where("length(value) >= 5")
    p = contact_keys(spark, folder).where("source = 'people'").groupBy("value").agg(F.count_distinct("record").alias("n"), F.min("record").alias("person"))
    owner = table(spark, folder, "participants", "email", "is_self").where("is_self").select(mail_key(F.col("email")).alias("value"), F.lit(True).alias("own")).distinct()
    j = h.join(p, "value", "left").join(owner, "value", "left")
    state = F.when(F.col("own"), "owner").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return j.select("source_rowid", state.alias("state"), F.when((state == "resolved"), F.col("person")).alias("person"))


def conversation_people(spark: SparkSession, folder: str) -> DataFrame:
    """Who belongs to a chat: those who write in it, guests of the event it is named after, and the contact it is with."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "handle_rowid").where("handle_rowid <> 0").distinct()
    h = table(spark, folder, "handles", "source_rowid", "handle").where("trim(handle) <> ''").distinct()
    senders = m.join(h, m["handle_rowid"] == h["source_rowid"]).select("chat_rowid", F.trim("handle").alias("identity"))
    chats = table(spark, folder, "chats", "source_rowid", "jid", "name").distinct()
    contacts = table(spark, folder, "contacts", "jid").distinct()
    contact = chats.join(contacts, "jid", "left_semi").select(F.col("source_rowid").alias("chat_rowid"), F.col("jid").alias("identity"))
    events = table(spark, folder, "calendar_events", "event_uid", "summary").where("trim(summary) <> ''").distinct()
    guests = table(spark, folder, "participants", "event_uid", "email").where("trim(email) <> ''").distinct()
    named = chats.join(events, F.lower(F.trim(chats["name"])) == F.lower(F.trim(events["summary"]))).join(guests, "event_uid").select(F.col("source_rowid").alias("chat_rowid"), mail_key(F.col("email")).alias("identity"))
    return senders.unionByName(contact).unionByName(named).where("chat_rowid is not null").distinct()


def direct_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chats with exactly one other person, who is in the address book by number or mailbox."""
    m = table(spark, folder, "chat_messages", "chat_rowid", "handle_rowid").where("handle_rowid <> 0")
    one = m.groupBy("chat_rowid").agg(F.count_distinct("handle_rowid").alias("n"), F.min("handle_rowid").alias("handle_rowid")).where("n = 1")
    k = contact_keys(spark, folder)
    known = k.where("source = 'handles'").select("record", "kind", "value").join(k.where("source = 'people'").select("kind", "value").distinct(), ["kind", "value"], "left_semi").select(F.col("record").cast("long").alias("handle_rowid")).distinct()
    return one.join(known, "handle_rowid", "left_semi").select("chat_rowid", "handle_rowid")


def strong_rematches(spark: SparkSession, folder: str) -> DataFrame:
    """Handles moved to the one person who shares an identifier with them; those whom several share stay."""
    k = contact_keys(spark, folder)
    return unique_match(k.where("source = 'handles'"), k.where("source = 'people'"), ["kind", "value"], "record").select(F.col("record").alias("handle"), "person")


def household_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Address-book records of a shared number after the repair: one stays in a group only if it shares a key of its own with every other."""
    k = contact_keys(spark, folder).select(F.concat_ws(":", "source", "record").alias("record"), "source", "kind", "value")
    shared = ambiguous_keys(k, ["kind", "value"], "source", "record")
    return repaired_groups(k, shared, ["kind", "value"], "record")


def refreshed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes' titles and folders after a current snapshot, which refreshes them, and a historical one, which only adds."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "title", "folder", "source", "first_observed_at").distinct()
    pick = lambda df: latest(df, ["note_id"], ["first_observed_at", "observation_id"]).select("note_id", "title", "folder")
    cut = "timestamp'2023-01-01 00:00:00'"
    stored, current, historical = (pick(v.where(w)) for w in (f"first_observed_at < {cut}", f"first_observed_at >= {cut} and pmod(observation_id, 2) = 0", f"first_observed_at >= {cut} and pmod(observation_id, 2) = 1"))
    kept = refresh_or_insert(stored, current, "note_id", current_snapshot=True)
    return refresh_or_insert(kept, historical, "note_id", current_snapshot=False).select("note_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("folder", F.lit("")).alias("folder"))


EVENT_FIELDS = ("summary", "description", "location_title", "location_address", "organizer_name", "calendar_title")


def matched_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of an event in which the query occurs, in the order of the fields; a text already given by an earlier field is left out."""
    e = latest(table(spark, folder, "calendar_events", "event_uid", *EVENT_FIELDS, "ingested_at"), ["event_uid"], ["ingested_at"])
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    fields = []
    for i, c in enumerate(EVENT_FIELDS):
        repeated = F.lit(False)
        for d in EVENT_FIELDS[:i]:
            repeated = repeated | (text(F.col(c)) == text(F.col(d)))
        fields.append(F.when(text(F.col(c)).contains("harbour") & ~repeated, F.lit(c)))
    return e.select("event_uid", F.array_join(F.array_compact(F.array(*fields)), ",").alias("fields")).where("fields <> ''")


def message_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that a message's own fields tell: attachment, reaction, notice, link, question, long, reply mark; each once."""
    m = table(spark, folder, "chat_messages", "message_rowid", "text", "item_type", "associated_message_type", "has_attachments")
    tests = {
        "attachment": F.col("has_attachments"), "reaction": F.coalesce("associated_message_type", F.lit(0)) != 0, "notice": F.coalesce("item_type", F.lit(0)) != 0,
        "link": F.col("text").rlike("https?://"), "question": F.trim("text").endswith("?"), "long": F.length("text") > 200,
    }
    tags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return m.select("message_rowid", F.explode(tags).alias("tag")).distinct()


def classification_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Notes to classify: new texts that no finished work covers, and finished ones due for a refresh."""
    v = table(spark, folder, "note_versions", "note_id", "text", "first_observed_at", "latest_observed_at").where("text is not null")
    rows = v.select("note_id", F.sha2("text", 256).alias("digest"), "first_observed_at", "latest_observed_at")
    wanted = rows.groupBy("note_id", "digest").agg(F.min("first_observed_at").alias("since"))
    done = rows.where("first_observed_at < timestamp'2023-01-01 00:00:00'").groupBy("note_id", "digest").agg(F.max("latest_observed_at").alias("finished"))
    return work_queue(wanted, done, ["note_id", "digest"], F.col("finished") < F.lit("2022-01-01 00:00:00").cast("timestamp"))


def claimed_work(spark: SparkSession, folder: str) -> DataFrame:
    """Claims under a cap of three per calendar: earliest first, and an event claims once."""
    e = table(spark, folder, "calendar_events", "event_uid", "calendar_title", "ingested_at").where("calendar_title is not null")
    asked = e.groupBy("calendar_title", "event_uid").agg(F.min("ingested_at").alias("asked"))
    return capped_claims(asked, ["calendar_title"], "event_uid", "asked", 3).select("calendar_title", "event_uid", "claim")


def changed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a later look whose (modified, size) differs from the one before the cut, or that are new."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "modified_at", "text", "first_observed_at").distinct()
    v = v.select("note_id", "observation_id", "first_observed_at", "modified_at", F.length("text").alias("size"))
    at = ["first_observed_at", "observation_id"]
    cut = "timestamp'2023-01-01 00:00:00'"
    return changed_since(latest(v.where(f"first_observed_at < {cut}"), ["note_id"], at), latest(v.where(f"first_observed_at >= {cut}"), ["note_id"], at), "note_id", ["modified_at", "size"])


def history_states(spark: SparkSession, folder: str) -> DataFrame:
    """How far each chat's history is read: nothing, begun (rows still undated), or complete back to its first row."""
    chats = table(spark, folder, "chats", "source_rowid").distinct()
    m = table(spark, folder, "chat_messages", "chat_rowid", "message_rowid", "date")
    seen = m.groupBy("chat_rowid").agg(F.count_distinct("message_rowid").alias("messages"), F.count(F.when(F.coalesce("date", F.lit(0)) <= 0, 1)).alias("undated"), F.min(F.when(F.col("date") > 0, F.col("message_rowid"))).alias("oldest"), F.min("message_rowid").alias("first"))
    j = chats.join(seen, chats["source_rowid"] == seen["chat_rowid"], "left")
    state = F.when(F.col("messages").isNull(), "not begun").when((F.col("undated") == 0) & (F.col("oldest") == F.col("first")), "complete").otherwise("begun")
    return j.select("source_rowid", state.alias("state"), F.coalesce("messages", F.lit(0)).alias("messages"))


def index_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Records and indexed records per source, with those the index lacks and those only it has."""
    def counts(name: str, there: DataFrame, held: DataFrame) -> DataFrame:
        both = there.withColumn("there", F.lit(True)).join(held.withColumn("held", F.lit(True)), "key", "full")
        return both.agg(F.lit(name).alias("source"), F.count("there").alias("records"), F.count("held").alias("indexed"), F.count_if(F.col("held").isNull()).alias("missing"), F.count_if(F.col("there").isNull()).alias("orphans"))

    mails = table(spark, folder, "messages", "id", "body", "ingested_at")
    notes = table(spark, folder, "note_versions", "note_id", "text_status")
    out = counts("mails", mails.select(F.col("id").alias("key")).distinct(), mails.where("trim(body) <> '' and ingested_at < timestamp'2024-01-01 00:00:00'").select(F.col("id").alias("key")).distinct())
    return out.unionByName(counts("notes", notes.where("text_status <> 'missing'").select(F.col("note_id").alias("key")).distinct(), notes.where("text_status = 'decoded'").select(F.col("note_id").alias("key")).distinct()))


def record_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of records that are to be opened: no key, no time, a time out of range, no text, a bad link in it."""
    t = latest(table(spark, folder, "tweets", "id", "created_at", "text", "author_id", "ingested_at"), ["id"], ["ingested_at"])
    year = F.year("created_at")
    faults = F.array_compact(F.array(
        F.when(~F.col("id").rlike("^[0-9]{1,19}$"), "key"), F.when(F.col("created_at").isNull(), "no time").when((year < 2006) | (year > 2100), "time"),
        F.when(blank_to_null(F.col("text")).isNull(), "no text"), F.when(F.col("text").rlike(r"http://|https://(?:\s|$)"), "link"), F.when(blank_to_null(F.col("author_id")).isNull(), "no author"),
    ))
    return t.select("id", F.explode(faults).alias("fault"))


def person_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Description of each person with its date: the newest one that is not blank, and how many there were."""
    p = table(spark, folder, "people", "id", "relationship_context", "updated_at").where("trim(relationship_context) <> ''").distinct()
    return p.groupBy("id").agg(F.max_by(F.trim("relationship_context"), F.struct("updated_at", F.trim("relationship_context"))).alias("context"), F.max(F.unix_seconds("updated_at")).alias("dated_s"), F.count_distinct(F.trim("relationship_context")).alias("texts"))


def contact_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty people who fit the question: most mails first, then rank, those with a time, the latest, and the name."""
    p = latest(table(spark, folder, "people", "id", "name", "updated_at"), ["id"], ["updated_at"]).withColumn("rank", match_rank(F.lit(QUESTION), F.col("name"))).where("rank is not null")
    k = contact_keys(spark, folder).where("source = 'people' and kind = 'email'").select(F.col("record").alias("id"), "value")
    m = table(spark, folder, "messages", "id", "from_address", "ingested_at").select(F.col("id").alias("mail"), mail_key(F.col("from_address")).alias("value"), "ingested_at")
    use = k.join(m, "value").groupBy("id").agg(F.count_distinct("mail").alias("mails"), F.max(F.unix_seconds("ingested_at")).alias("latest_s"))
    j = p.join(use, "id", "left").select("id", "name", "rank", F.coalesce("mails", F.lit(0)).alias("mails"), F.coalesce("latest_s", F.lit(-1).cast("long")).alias("latest_s"))
    return j.orderBy(F.desc("mails"), F.desc("rank"), F.desc(F.col("latest_s") >= 0), F.desc("latest_s"), F.lower("name"), "id").limit(20)


def pending_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places still to be looked up: those of new events that no finished look-up of the same place covers."""
    e = table(spark, folder, "calendar_events", "event_uid", "location_address", "status", "ingested_at").where("trim(location_address) <> ''")
    place = F.md5(F.concat(F.lit("v1|"), F.lower(F.trim(F.regexp_replace("location_address", r"\s+", " ")))))
    e = e.withColumn("place", place)
    finished = e.where("ingested_at < timestamp'2023-01-01 00:00:00' and status is distinct from 'tentative'").select("place").distinct()
    return e.join(finished, "place", "left_anti").groupBy("place").agg(F.count_distinct("event_uid").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        owner_messages, chat_participant_identities, group_authors, messages_by_keys, clean_identities, contact_aliases, contact_who, post_people, exact_identifiers, conversation_people, direct_chats,
        strong_rematches, household_groups, refreshed_notes, matched_fields, message_tags, classification_queue, claimed_work, changed_notes, history_states, index_parity, record_faults, person_annotations,
        contact_candidates, pending_places,
    )
}

_TRIM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_CUT = "timestamptz '2023-01-01 00:00:00+00'"
_MAIL = "lower(trim(regexp_replace(trim({0}), '^mailto:', '', 'i')))"
_KEYS = f"""
keys as (select distinct * from (
  select 'people' as source, person_id as record, kind, case when kind = 'email' then {_MAIL.format('value')} else {_PHONE.format('value')} end as value from contact_values where kind in ('phone', 'email') and trim(value) <> ''
  union all select 'contacts', jid, 'phone', {_PHONE.format('phone')} from contacts where phone is not null
  union all select 'handles', cast(source_rowid as varchar), case when contains(handle, '@') then 'email' else 'phone' end, case when contains(handle, '@') then {_MAIL.format('handle')} else {_PHONE.format('handle')} end from handles where handle is not null)
  where length(value) >= 5)"""
_FIELDS = ", ".join(f"lower(trim(coalesce({c}, ''))) as f{i}" for i, c in enumerate(EVENT_FIELDS))
_HIT = ", ".join("case when contains(f{0}, 'harbour'){1} then '{2}' end".format(i, "".join(f" and f{i} <> f{j}" for j in range(i)), c) for i, c in enumerate(EVENT_FIELDS))
_LATEST = "(select * from (select *, row_number() over (partition by note_id order by first_observed_at desc, observation_id desc) as rn from v where {0}) where rn = 1)"

SQL = {
    "owner_messages": f"""
select chat_rowid, count(distinct message_rowid) as messages, (select min({_MAIL.format('email')}) from participants where is_self and trim(email) <> '') as owner
from chat_messages where is_from_me group by 1""",
    "chat_participant_identities": """
with h as (select distinct source_rowid, coalesce(nullif(trim(handle), ''), nullif(trim(display_name), '')) as identity from handles),
p as (select distinct m.chat_rowid, h.identity from chat_messages m join h on m.handle_rowid = h.source_rowid where m.handle_rowid <> 0 and m.chat_rowid is not null and h.identity is not null)
select chat_rowid, string_agg(identity, ', ' order by identity) as identities from p group by 1""",
    "group_authors": """
select chat_rowid, count(distinct handle_rowid) filter (handle_rowid <> 0) as authors, count(distinct message_rowid) filter (is_from_me) as own
from chat_messages where chat_rowid in (select source_rowid from chats where kind = 'group') group by 1""",
    "messages_by_keys": "select distinct like_count as message_rowid, like_count in (select message_rowid from chat_messages where message_rowid is not null) as found from tweets where like_count is not null",
    "clean_identities": f"""
with c as (select distinct jid, full_name from contacts)
select jid, regexp_replace({_TRIM.format("regexp_replace(jid, '[\\p{Cf}]', '', 'g')")}, '(@lid)(@lid)+$', '\\1') as identity,
       coalesce(regexp_replace({_TRIM.format("regexp_replace(full_name, '[\\p{Cf}]', '', 'g')")}, '(@lid)(@lid)+$', '\\1'), '') as name from c""",
    "contact_aliases": " union ".join(
        [f"select jid, 'name' as kind, trim({c}) as alias from contacts where trim({c}) <> ''" for c in _NAMES]
        + ["select jid, 'name', trim(concat_ws(' ', trim(first_name), trim(last_name))) from contacts where trim(concat_ws(' ', trim(first_name), trim(last_name))) <> ''"]
        + [f"select jid, 'identifier', trim({c}) from contacts where trim({c}) <> ''" for c in _IDS]
    ),
    "post_people": """
with t as (select *, coalesce(nullif(trim(conversation_id), ''), id) as talk from tweets),
p as (select distinct id, lower(author_handle) as handle from tweets),
e as (select talk, lower(author_handle) as handle, 'author' as role from t union select t.talk, p.handle, 'answered' from t join p on t.in_reply_to_id = p.id where trim(t.in_reply_to_id) <> ''
      union select talk, lower(unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_@.])@([A-Za-z0-9_]+)', 1))), 'named' from t)
select talk, handle, string_agg(role, ',' order by role) as roles from e where handle <> '' group by 1, 2""",
    "exact_identifiers": f"""
with {_KEYS}, h as (select distinct source_rowid, case when contains(handle, '@') then {_MAIL.format('handle')} else {_PHONE.format('handle')} end as value from handles where trim(handle) <> ''),
p as (select value, count(distinct record) as n, min(record) as person from keys where source = 'people' group by 1),
o as (select distinct {_MAIL.format('email')} as value from participants where is_self)
select source_rowid, case when o.value is not null then 'owner' when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unknown' end as state, case when o.value is null and n = 1 then person end as person
from h left join p using (value) left join o on h.value = o.value where length(h.value) >= 5""",
    "conversation_people": f"""
select distinct m.chat_rowid, trim(h.handle) as identity from chat_messages m join handles h on m.handle_rowid = h.source_rowid where m.handle_rowid <> 0 and trim(h.handle) <> '' and m.chat_rowid is not null
union select source_rowid, jid from chats where jid in (select jid from contacts)
union select c.source_rowid, {_MAIL.format('g.email')} from chats c join calendar_events e on lower(trim(c.name)) = lower(trim(e.summary)) join participants g on e.event_uid = g.event_uid where trim(e.summary) <> '' and trim(g.email) <> ''""",
    "direct_chats": f"""
with {_KEYS}, one as (select chat_rowid, min(handle_rowid) as handle_rowid from chat_messages where handle_rowid <> 0 group by 1 having count(distinct handle_rowid) = 1)
select * from one where handle_rowid in (select cast(record as bigint) from keys k where source = 'handles' and exists (select 1 from keys p where p.source = 'people' and p.kind = k.kind and p.value = k.value))""",
    "strong_rematches": f"""
with {_KEYS} select h.record as handle, min(p.record) as person from keys h join keys p on h.kind = p.kind and h.value = p.value where h.source = 'handles' and p.source = 'people' group by 1 having count(distinct p.record) = 1""",
    "household_groups": f"""
with {_KEYS}, k as (select source || ':' || record as record, source, kind, value from keys),
amb as (select kind, value from (select kind, value, source, count(distinct record) as n from k group by 1, 2, 3) group by 1, 2 having max(n) > 1),
m as (select distinct k.kind, k.value, k.record from k join amb using (kind, value)),
own as (select * from k where not exists (select 1 from amb where amb.kind = k.kind and amb.value = k.value)),
links as (select m.kind, m.value, m.record, count(distinct n.record) as linked from m join own a on m.record = a.record join own b on a.kind = b.kind and a.value = b.value join m n on n.record = b.record and n.kind = m.kind and n.value = m.value and n.record <> m.record group by 1, 2, 3),
size as (select kind, value, count(*) as n from m group by 1, 2)
select m.kind, m.value, m.record, coalesce(linked, 0) = size.n - 1 as stays from m join size using (kind, value) left join links using (kind, value, record)""",
    "refreshed_notes": f"""
with v as (select distinct note_id, observation_id, title, folder, first_observed_at from note_versions),
a as {_LATEST.format(f'first_observed_at < {_CUT}')}, b as {_LATEST.format(f'first_observed_at >= {_CUT} and observation_id % 2 = 0')}, c as {_LATEST.format(f'first_observed_at >= {_CUT} and observation_id % 2 = 1')},
k as (select note_id, title, folder from b union all select note_id, title, folder from a where note_id not in (select note_id from b))
select note_id, coalesce(title, '') as title, coalesce(folder, '') as folder from (select * from k union all select note_id, title, folder from c where note_id not in (select note_id from k))""",
    "matched_fields": f"""
with e as (select *, row_number() over (partition by event_uid order by ingested_at desc) as rn from calendar_events), f as (select event_uid, {_FIELDS} from e where rn = 1)
select event_uid, array_to_string(list_filter([{_HIT}], lambda x: x is not null), ',') as fields from f where fields <> ''""",
    "message_tags": """
select distinct message_rowid, tag from (select message_rowid, unnest([case when has_attachments then 'attachment' end, case when coalesce(associated_message_type, 0) <> 0 then 'reaction' end, case when coalesce(item_type, 0) <> 0 then 'notice' end,
  case when regexp_matches(text, 'https?://') then 'link' end, case when suffix(trim(text, ' '), '?') then 'question' end, case when length(text) > 200 then 'long' end]) as tag from chat_messages) where tag is not null""",
    "classification_queue": f"""
with r as (select note_id, sha256(text) as digest, first_observed_at, latest_observed_at from note_versions where text is not null),
w as (select note_id, digest, min(first_observed_at) as since from r group by 1, 2), d as (select note_id, digest, max(latest_observed_at) as finished from r where first_observed_at < {_CUT} group by 1, 2)
select note_id, digest, 'new' as reason from w where not exists (select 1 from d where d.note_id = w.note_id and d.digest = w.digest)
union all select w.note_id, w.digest, 'refresh' from w join d using (note_id, digest) where finished < timestamptz '2022-01-01 00:00:00+00'""",
    "claimed_work": """
select * from (select calendar_title, event_uid, row_number() over (partition by calendar_title order by asked, event_uid) as claim
from (select calendar_title, event_uid, min(ingested_at) as asked from calendar_events where calendar_title is not null group by 1, 2)) where claim <= 3""",
    "changed_notes": f"""
with v as (select distinct note_id, observation_id, first_observed_at, modified_at, length(text) as size from note_versions),
a as {_LATEST.format(f'first_observed_at < {_CUT}')}, b as {_LATEST.format(f'first_observed_at >= {_CUT}')}
select b.note_id, case when a.note_id is null then 'new' else 'changed' end as change from b left join a using (note_id)
where a.note_id is null or a.modified_at is distinct from b.modified_at or a.size is distinct from b.size""",
    "history_states": """
with s as (select chat_rowid, count(distinct message_rowid) as messages, count(*) filter (coalesce(date, 0) <= 0) as undated, min(case when date > 0 then message_rowid end) as oldest, min(message_rowid) as first from chat_messages group by 1)
select source_rowid, case when messages is null then 'not begun' when undated = 0 and oldest = first then 'complete' else 'begun' end as state, coalesce(messages, 0) as messages
from (select distinct source_rowid from chats) c left join s on c.source_rowid = s.chat_rowid""",
    "index_parity": """
with a as (select distinct id as key from messages), b as (select distinct id as key from messages where trim(body, ' ') <> '' and ingested_at < timestamptz '2024-01-01 00:00:00+00'),
c as (select distinct note_id as key from note_versions where text_status <> 'missing'), d as (select distinct note_id as key from note_versions where text_status = 'decoded')
select 'mails' as source, count(a.key) as records, count(b.key) as indexed, count(*) filter (b.key is null) as missing, count(*) filter (a.key is null) as orphans from a full join b on a.key = b.key
union all select 'notes', count(c.key), count(d.key), count(*) filter (d.key is null), count(*) filter (c.key is null) from c full join d on c.key = d.key""",
    "record_faults": """
with t as (select *, row_number() over (partition by id order by ingested_at desc) as rn from tweets)
select id, fault from (select id, unnest([case when not regexp_full_match(id, '[0-9]{1,19}') then 'key' end, case when created_at is null then 'no time' when year(created_at) < 2006 or year(created_at) > 2100 then 'time' end,
  case when coalesce(trim(text, ' '), '') = '' then 'no text' end, case when regexp_matches(text, 'http://|https://(\\s|$)') then 'link' end, case when coalesce(trim(author_id), '') = '' then 'no author' end]) as fault from t where rn = 1) where fault is not null""",
    "person_annotations": """
select id, arg_max(c, {'a': updated_at, 'b': c}) as context, max(cast(floor(epoch(updated_at)) as bigint)) as dated_s, count(distinct c) as texts
from (select distinct id, trim(relationship_context) as c, updated_at from people where trim(relationship_context) <> '') group by 1""",
    "pending_places": f"""
with e as (select event_uid, status, ingested_at, md5('v1|' || lower({_TRIM.format('location_address')})) as place from calendar_events where trim(location_address, ' ') <> '')
select place, count(distinct event_uid) as events from e where place not in (select place from e where ingested_at < {_CUT} and status is distinct from 'tentative') group by 1""",
}
