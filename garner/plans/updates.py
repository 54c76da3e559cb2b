"""Ingestion: snapshots compared and merged, duplicates folded, versions and states kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.operators.history import attribute_hash, merge_type_two
from garner.operators.ingest import content_versions, fingerprint, fold_duplicates, is_stale, merge_columns, pending, snapshot_changes, source_state
from garner.operators.windows import latest
from garner.sources.tables import table

CUT = "timestamp'2023-01-01 00:00:00'"


def _halves(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The table as it stood at the cut, and the rows that came later; the last row of each key counts."""
    rows = table(spark, folder, name, key, *columns, "ingested_at")
    pick = lambda df: latest(df, [key], ["ingested_at"])
    return pick(rows.where(f"ingested_at < {CUT}")), pick(rows.where(f"ingested_at >= {CUT}"))


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """New, changed, unchanged and deleted events between two snapshots, counted."""
    old, new = _halves(spark, folder, "calendar_events", "event_uid", "summary", "status", "start_time")
    return snapshot_changes(old, new, "event_uid", ["summary", "status", "start_time"]).groupBy("change").agg(F.count("*").alias("n"))


def merged_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts after a partial update: blank texts don't overwrite, counters only grow."""
    old, new = _halves(spark, folder, "tweets", "id", "author_handle", "text", "like_count", "retweet_count")
    m = merge_columns(old, new, "id", ["author_handle", "text"], ["like_count", "retweet_count"])
    return m.select("id", "author_handle", F.coalesce(F.length("text"), F.lit(-1)).alias("size"), F.coalesce("like_count", F.lit(-1)).alias("likes"), F.coalesce("retweet_count", F.lit(-1)).alias("retweets"))


def folded_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per poster: first name that is not blank by id, largest counters."""
    t = table(spark, folder, "tweets", "id", "author_id", "author_handle", "author_name", "like_count", "reply_count").where("author_id is not null")
    t = t.withColumn("answered", F.coalesce(F.col("reply_count") > 0, F.lit(False)))
    out = fold_duplicates(t, "author_id", ["id"], ["author_handle", "author_name"], ["like_count"], ["answered"])
    return out.withColumn("like_count", F.coalesce("like_count", F.lit(-1)))


def author_roles(spark: SparkSession, folder: str) -> DataFrame:
    """First and last time each poster was seen, and in how many posts."""
    t = table(spark, folder, "tweets", "id", "author_id", "ingested_at")
    return t.groupBy("author_id").agg(F.min(F.unix_seconds("ingested_at")).alias("first_s"), F.max(F.unix_seconds("ingested_at")).alias("last_s"), F.count_distinct("id").alias("posts"))


def note_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Content-addressed versions of every note with their sightings."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "text", "first_observed_at", "latest_observed_at").distinct()
    c = content_versions(v, "note_id", "text", "first_observed_at", "latest_observed_at")
    return c.select("note_id", "digest", F.unix_seconds("first_seen").alias("first_s"), F.unix_seconds("latest_seen").alias("latest_s"), "sightings")


def observations_once(spark: SparkSession, folder: str) -> DataFrame:
    """A text seen several times in a batch is kept once: the last sighting, at the place of the first."""
    v = table(spark, folder, "note_versions", "note_id", "observation_id", "text").where("text is not null")
    return v.groupBy("note_id", F.sha2("text", 256).alias("digest")).agg(F.min("observation_id").alias("place"), F.max("observation_id").alias("kept"))


def pending_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of documents, by source and language, whose digest differs from the one ingested before the cut."""
    d = table(spark, folder, "documents", "doc_id", "source", "lang", "text", "ingested_at").withColumn("lang", F.coalesce("lang", F.lit("")))
    # contents in any order: the sum of the digests' heads
    head = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 12), 16, 10).cast("decimal(38,0)")
    shard = lambda df: df.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(head).cast("string").alias("digest"))
    return pending(shard(d), shard(d.where(f"ingested_at < {CUT}")), ["source", "lang", "n", "digest"])


def note_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each note is current or was deleted at its source, and since when it is missing."""
    v = table(spark, folder, "note_versions", "note_id", "first_observed_at", "text_status").where("text_status <> 'unsupported'")
    s = source_state(v, "note_id", "first_observed_at", F.col("text_status") == "missing")
    return s.select("note_id", "state", F.coalesce(F.unix_seconds("first_missing"), F.lit(0).cast("long")).alias("missing_s"))


def stale_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of the last ninety days before a moment without metrics, or with metrics older than a week."""
    t = latest(table(spark, folder, "tweets", "id", "created_at", "like_count", "ingested_at"), ["id"], ["ingested_at"])
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    young = F.unix_seconds(now) - F.unix_seconds("created_at")
    return t.where(young.between(0, 90 * 86400)).where(F.col("like_count").isNull() | is_stale(F.col("ingested_at"), now, 7 * 86400)).select("id")


def row_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every contact's row."""
    c = table(spark, folder, "contacts", "jid", "full_name", "phone", "business_name").distinct()
    return c.select("jid", fingerprint(F.col("full_name"), F.col("phone"), F.col("business_name")).alias("digest"))


def contact_history(spark: SparkSession, folder: str) -> DataFrame:
    """Type-two history of events after one merge of a later snapshot into an earlier one."""
    old, new = _halves(spark, folder, "calendar_events", "event_uid", "summary", "status")
    current = old.select("event_uid", "summary", "status", attribute_hash(F.col("summary"), F.col("status")).alias("attribute_hash"), F.col("ingested_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    merged = merge_type_two(current, new, "event_uid", "ingested_at", ["summary", "status"])
    return merged.select("event_uid", "summary", "status", F.unix_seconds("valid_from").alias("from_s"), F.coalesce(F.unix_seconds("valid_to"), F.lit(0).cast("long")).alias("to_s"))


QUERIES = {
    f.__name__: f
    for f in (event_changes, merged_posts, folded_contacts, author_roles, note_contents, observations_once, pending_shards, note_states, stale_posts, row_fingerprints, contact_history)
}

_CUT = "timestamptz '2023-01-01 00:00:00+00'"
SQL = {
    "event_changes": f"""
with r as (select event_uid, ingested_at < {_CUT} as old, arg_max({{'a': summary, 'b': status, 'c': start_time}}, ingested_at) as v from calendar_events group by 1, 2),
m as (select case when o.event_uid is null then 'new' when n.event_uid is null then 'deleted' when o.v is not distinct from n.v then 'unchanged' else 'changed' end as change
      from (select * from r where old) o full join (select * from r where not old) n on o.event_uid = n.event_uid)
select change, count(*) as n from m group by 1""",
    "merged_posts": f"""
with r as (select id, ingested_at < {_CUT} as old, arg_max({{'h': author_handle, 't': text, 'l': like_count, 'r': retweet_count}}, ingested_at) as v from tweets group by 1, 2)
select coalesce(o.id, n.id) as id, coalesce(nullif(trim(n.v.h), ''), o.v.h) as author_handle, coalesce(length(coalesce(nullif(trim(n.v.t), ''), o.v.t)), -1) as size,
       coalesce(greatest(o.v.l, n.v.l), -1) as likes, coalesce(greatest(o.v.r, n.v.r), -1) as retweets
from (select * from r where old) o full join (select * from r where not old) n on o.id = n.id""",
    "folded_contacts": """
select author_id, arg_min(nullif(trim(author_handle), ''), id) as author_handle, arg_min(nullif(trim(author_name), ''), id) filter (nullif(trim(author_name), '') is not null) as author_name,
       coalesce(max(like_count), -1) as like_count, bool_or(coalesce(reply_count > 0, false)) as answered from tweets where author_id is not null group by 1""",
    "author_roles": "select author_id, cast(min(floor(epoch(ingested_at))) as bigint) as first_s, cast(max(floor(epoch(ingested_at))) as bigint) as last_s, count(distinct id) as posts from tweets group by 1",
    "note_contents": """
select note_id, sha256(text) as digest, cast(min(floor(epoch(first_observed_at))) as bigint) as first_s, cast(max(floor(epoch(latest_observed_at))) as bigint) as latest_s, count(*) as sightings
from (select distinct note_id, observation_id, text, first_observed_at, latest_observed_at from note_versions) where text is not null group by 1, 2""",
    "observations_once": "select note_id, sha256(text) as digest, min(observation_id) as place, max(observation_id) as kept from note_versions where text is not null group by 1, 2",
    "pending_shards": f"""
select source, coalesce(lang, '') as lang, count(*) as n, cast(sum(cast(cast('0x' || substr(md5(cast(doc_id as varchar) || ':' || coalesce(text, '')), 1, 12) as bigint) as hugeint)) as varchar) as digest from documents group by 1, 2
except select source, coalesce(lang, '') as lang, count(*) as n, cast(sum(cast(cast('0x' || substr(md5(cast(doc_id as varchar) || ':' || coalesce(text, '')), 1, 12) as bigint) as hugeint)) as varchar) as digest from documents where ingested_at < {_CUT} group by 1, 2""",
    "note_states": """
with v as (select note_id, first_observed_at as t, text_status = 'missing' as gone from note_versions where text_status <> 'unsupported'),
p as (select note_id, max(t) filter (not gone) as last from v group by 1),
m as (select v.note_id, min(t) as t from v join p using (note_id) where gone and (last is null or v.t > last) group by 1)
select p.note_id, case when m.t is null then 'current' else 'deleted_upstream' end as state, cast(coalesce(floor(epoch(m.t)), 0) as bigint) as missing_s from p left join m using (note_id)""",
    "stale_posts": """
with t as (select id, arg_max({'c': created_at, 'l': like_count}, ingested_at) as v, max(ingested_at) as i from tweets group by 1)
select id from t where floor(epoch(v.c)) between 1717200000 - 7776000 and 1717200000 and (v.l is null or 1717200000 - floor(epoch(i)) > 604800)""",
    "row_fingerprints": "select distinct jid, sha256(concat_ws(chr(1), coalesce('=' || full_name, '-'), coalesce('=' || phone, '-'), coalesce('=' || business_name, '-'))) as digest from contacts",
    "contact_history": f"""
with r as (select event_uid, ingested_at < {_CUT} as old, arg_max({{'a': summary, 'b': status}}, ingested_at) as v, cast(floor(epoch(max(ingested_at))) as bigint) as t from calendar_events group by 1, 2),
o as (select * from r where old), n as (select * from r where not old),
m as (select o.event_uid as oe, n.event_uid as ne, o.v as ov, n.v as nv, o.t as ot, n.t as nt,
             o.event_uid is not null and n.event_uid is not null and (regexp_replace(o.v.a, '\\s+', '', 'g') is distinct from regexp_replace(n.v.a, '\\s+', '', 'g') or o.v.b is distinct from n.v.b) as changed
      from o full join n on o.event_uid = n.event_uid)
select oe as event_uid, ov.a as summary, ov.b as status, ot as from_s, case when changed then nt else 0 end as to_s from m where oe is not null
union all select ne, nv.a, nv.b, nt, 0 from m where oe is null or changed""",
}
