"""Person matching, identity across sources, aliases and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.matching import match_rank
from garner.functions.text import MARKED, PLAIN, case_quality, compact, mail_key, normalised, phone_key, slug
from garner.operators.aliases import build, compose_link, lookup_table, parse_link, resolve
from garner.operators.components import connected_components
from garner.operators.windows import best_by_rank
from garner.session import cut
from garner.sources.tables import table

QUESTIONS = ("jasper", "Mark Garr", "nadja", "zofia", "lin", "Özge", "renee", "jorn", "+1 (555) 0100")


def name_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of every person's name for each question that it fits."""
    p = table(spark, folder, "people", "id", "name").distinct()
    asked = p.withColumn("question", F.explode(F.array(*[F.lit(q) for q in QUESTIONS])))
    return asked.select("id", "question", match_rank(F.col("question"), F.col("name")).alias("rank")).where("rank is not null")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Posters found for a question in order: posts, rank, latest post and name; direct matches hide close spellings."""
    t = table(spark, folder, "tweets", "id", "author_name", "created_at").distinct()
    who = t.groupBy(normalised(F.col("author_name")).alias("name")).agg(F.count("*").alias("posts"), F.max(F.unix_seconds("created_at")).alias("latest_s"))
    ranked = who.withColumn("rank", match_rank(F.lit("ja"), F.col("name"))).where("rank is not null")
    direct = ranked.agg(F.max(F.col("rank") > 1)).first()[0]
    kept = ranked.where("rank > 1") if direct else ranked
    return kept.orderBy(F.desc("posts"), F.desc("rank"), F.desc("latest_s"), "name").limit(20)


def merged_names(spark: SparkSession, folder: str) -> DataFrame:
    """Senders merged by name without regard to case and blanks: mailboxes, latest mail, mails and best spelling."""
    m = table(spark, folder, "messages", "id", "from_name", "from_address", "ingested_at").where("trim(from_name) <> ''")
    spelt = m.groupBy(normalised(F.col("from_name")).alias("key"), F.trim("from_name").alias("name")).agg(F.count("*").alias("n"))
    best = best_by_rank(spelt, ["key"], [F.desc(case_quality(F.col("name"))), F.desc("n"), F.col("name")]).select("key", "name")
    facts = m.groupBy(normalised(F.col("from_name")).alias("key")).agg(
        F.array_join(F.sort_array(F.collect_set(F.lower("from_address"))), ",").alias("mailboxes"), F.max(F.unix_seconds("ingested_at")).alias("latest_s"), F.count_distinct("id").alias("mails")
    )
    return facts.join(best, "key")


def contact_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(source, record, kind, value) of every identifier in one form."""
    v = table(spark, folder, "contact_values", "person_id", "kind", "value").where("kind in ('phone', 'email') and trim(value) <> ''")
    values = v.select(F.lit("people").alias("source"), F.col("person_id").alias("record"), "kind", F.when(F.col("kind") == "email", mail_key(F.col("value"))).otherwise(phone_key(F.col("value"))).alias("value"))
    c = table(spark, folder, "contacts", "jid", "phone").where("phone is not null")
    numbers = c.select(F.lit("contacts").alias("source"), F.col("jid").alias("record"), F.lit("phone").alias("kind"), phone_key(F.col("phone")).alias("value"))
    h = table(spark, folder, "handles", "source_rowid", "handle").where("handle is not null")
    mail = F.col("handle").contains("@")
    handles = h.select(F.lit("handles").alias("source"), F.col("source_rowid").cast("string").alias("record"), F.when(mail, "email").otherwise("phone").alias("kind"), F.when(mail, mail_key(F.col("handle"))).otherwise(phone_key(F.col("handle"))).alias("value"))
    return values.unionByName(numbers).unionByName(handles).where("length(value) >= 5").distinct()


def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers by kind: those that several records of one source share are ambiguous and never join."""
    k = contact_keys(spark, folder).groupBy("kind", "value", "source").agg(F.count_distinct("record").alias("n"))
    flagged = k.groupBy("kind", "value").agg(F.max("n").alias("most"), F.count("*").alias("sources"))
    return flagged.groupBy("kind").agg(F.count(F.when(F.col("most") > 1, 1)).alias("ambiguous"), F.count(F.when((F.col("most") == 1) & (F.col("sources") > 1), 1)).alias("joining"), F.count("*").alias("keys"))


def identities(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all sources joined through identifiers that are unique within each source: record and its group."""
    k = cut(contact_keys(spark, folder).withColumn("node", F.concat_ws(":", "source", "record")))
    good = k.groupBy("kind", "value", "source").agg(F.count_distinct("record").alias("n")).groupBy("kind", "value").agg(F.max("n").alias("most"), F.count("*").alias("sources")).where("most = 1 and sources > 1")
    joined = k.join(good, ["kind", "value"])
    hub = joined.groupBy("kind", "value").agg(F.min("node").alias("b"))
    edges = joined.join(hub, ["kind", "value"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return connected_components(k.select("node"), edges)


def match_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Person of each handle by the strongest evidence: mailbox before number; ties go to the smallest person."""
    k = contact_keys(spark, folder)
    people = k.where("source = 'people'").select("kind", "value", F.col("record").alias("person"))
    h = k.where("source = 'handles'").select(F.col("record").alias("handle"), "kind", "value")
    met = h.join(people, ["kind", "value"]).withColumn("strength", F.when(F.col("kind") == "email", 1).otherwise(2))
    best = met.groupBy("handle").agg(F.min(F.struct("strength", "person")).alias("b"))
    return best.select("handle", "b.strength", "b.person")


def normal_phones(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and mailboxes of people in one form."""
    v = table(spark, folder, "contact_values", "person_id", "kind", "position", "value").where("kind in ('phone', 'email')").distinct()
    return v.select("person_id", "kind", "position", F.when(F.col("kind") == "email", mail_key(F.col("value"))).otherwise(phone_key(F.col("value"))).alias("value"))


def derived_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Stable id of each person's identifiers: eight bytes of the digest over the sorted keys."""
    k = contact_keys(spark, folder).where("source = 'people'")
    joined = k.groupBy("record").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "kind", "value"))), "|").alias("keys"))
    return joined.select(F.col("record").alias("person_id"), F.substring(F.sha2("keys", 256), 1, 16).alias("derived_id"))


def name_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Slug and compact form of every person's name."""
    p = table(spark, folder, "people", "id", "name").distinct()
    return p.select("id", slug(F.col("name")).alias("slug"), compact(F.col("name")).alias("compact"))


def _references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tweets", "id").select(F.concat(F.lit("tweets/"), "id").alias("full_ref"))


def short_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Short alias of every post and the link made of it, which parses back to the same parts."""
    e = build(_references(spark, folder), "full_ref")
    link = compose_link(F.lit("x"), F.col("alias"))
    return e.select("full_ref", "alias", link.alias("link"), (parse_link(link)["alias"] == F.col("alias")).alias("round_trip"))


def alias_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """State of aliases asked for by their first five characters, and of one that does not exist."""
    e = cut(build(_references(spark, folder), "full_ref"))
    asked = e.select(F.substring("alias", 1, 5).alias("alias")).union(spark.range(1).select(F.lit("zzzzzzzz").alias("alias")))
    return resolve(lookup_table(e), asked)


QUERIES = {
    f.__name__: f
    for f in (name_ranks, candidates, merged_names, contact_keys, unique_keys, identities, match_priority, normal_phones, derived_ids, name_slugs, short_aliases, alias_lookups)
}

_COMPACT = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
_NORMAL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_MAIL = "lower(trim(regexp_replace(trim({0}), '^mailto:', '', 'i')))"
# the pattern engine has no look-ahead: the trunk zero goes when the whole number has the right length
_PHONE = (
    "(select case when regexp_full_match(d, '(31|44|49|33|39|34|46|47|45|32|43|41|48)0[0-9]{{6,12}}') then substr(d, 1, 2) || substr(d, 4) else d end "
    "from (select regexp_replace(regexp_replace({0}, '[^0-9]', '', 'g'), '^00', '') as d))"
)
_KEYS = f"""
keys as (
  select distinct * from (
    select 'people' as source, person_id as record, kind, case when kind = 'email' then {_MAIL.format('value')} else {_PHONE.format('value')} end as value
    from contact_values where kind in ('phone', 'email') and trim(value) <> ''
    union all select 'contacts', jid, 'phone', {_PHONE.format('phone')} from contacts where phone is not null
    union all select 'handles', cast(source_rowid as varchar), case when contains(handle, '@') then 'email' else 'phone' end,
      case when contains(handle, '@') then {_MAIL.format('handle')} else {_PHONE.format('handle')} end from handles where handle is not null)
  where length(value) >= 5)"""

_FIRST = "substr(translate(lower(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')), '" + MARKED + "', '" + PLAIN + "'), 1, 1)"
_SWAPPED = "(length({0}) = length({1}) and {0} <> {1} and list_contains(list_transform(range(1, length({0})), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1, 1) || substr({0}, i, 1) || substr({0}, i + 2)), {1}))"
_ALLOWED = "case when greatest(length({0}), length({1})) <= 8 then 1 when greatest(length({0}), length({1})) <= 12 then 2 else 3 end"


def _close(a: str, b: str) -> str:
    return f"(length({a}) >= 3 and length({b}) >= 3 and {_FIRST.format(a)} = {_FIRST.format(b)} and {_FIRST.format(a)} <> '' and (levenshtein({a}, {b}) <= {_ALLOWED.format(a, b)} or {_SWAPPED.format(a, b)}))"


_ASKED = "q(question) as (values " + ", ".join(f"('{q}')" for q in QUESTIONS) + ")"

SQL = {
    "name_ranks": f"""
with {_ASKED}, p as (select distinct id, name from people),
k as (select id, question, {_NORMAL.format('question')} as q, {_NORMAL.format('name')} as v, {_COMPACT.format('question')} as qc, {_COMPACT.format('name')} as vc from p, q),
w as (select id, question, unnest(string_split(q, ' ')) as x, list_filter(regexp_split_to_array(v, '[^\\p{{L}}\\p{{Nd}}]+'), lambda y: y <> '') as ws from k),
x as (select id, question, x, {_COMPACT.format('x')} as xc, unnest(ws) as y from w),
c as (select id, question, x, bool_or(xc = y or {_close('xc', 'y')}) as hit from x group by 1, 2, 3),
a as (select id, question, bool_and(hit) as words from c group by 1, 2),
r as (select k.id, k.question, case when q = v or qc = vc then 4 when starts_with(v, q) or starts_with(vc, qc) then 3 when contains(v, q) or contains(vc, qc) then 2
             when {_close('qc', 'vc')} or a.words then 1 end as rank from k left join a using (id, question) where qc <> '' and vc <> '')
select * from r where rank is not null""",
    "contact_keys": f"with {_KEYS} select * from keys",
    "unique_keys": f"""
with {_KEYS}, k as (select kind, value, source, count(distinct record) as n from keys group by 1, 2, 3), f as (select kind, value, max(n) as most, count(*) as sources from k group by 1, 2)
select kind, count(*) filter (most > 1) as ambiguous, count(*) filter (most = 1 and sources > 1) as joining, count(*) as keys from f group by 1""",
    "identities": f"""
with recursive {_KEYS}, n as (select *, source || ':' || record as node from keys),
g as (select kind, value from (select kind, value, source, count(distinct record) as c from keys group by 1, 2, 3) group by 1, 2 having max(c) = 1 and count(*) > 1),
e as (select distinct a.node as a, b.node as b from n a join g using (kind, value) join n b on a.kind = b.kind and a.value = b.value),
reach(a, b) as (select distinct node, node from n union select r.a, e.b from reach r join e on r.b = e.a)
select a as node, min(b) as component from reach group by 1""",
    "match_priority": f"""
with {_KEYS}, p as (select kind, value, record as person from keys where source = 'people'), h as (select record as handle, kind, value from keys where source = 'handles'),
m as (select handle, case when kind = 'email' then 1 else 2 end as strength, person from h join p using (kind, value))
select handle, strength, min(person) as person from m where (handle, strength) in (select handle, min(strength) from m group by 1) group by 1, 2""",
    "normal_phones": f"""
select person_id, kind, position, case when kind = 'email' then {_MAIL.format('value')} else {_PHONE.format('value')} end as value
from (select distinct person_id, kind, position, value from contact_values where kind in ('phone', 'email'))""",
    "derived_ids": f"""
with {_KEYS}, j as (select record, array_to_string(list_sort(list(distinct kind || '=' || value)), '|') as k from keys where source = 'people' group by 1)
select record as person_id, substr(sha256(k), 1, 16) as derived_id from j""",
    "name_slugs": f"""
select id, case when s = '' then 'person' else s end as slug, {_COMPACT.format('name')} as compact from (
  select distinct id, name, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{{L}}\\p{{Nd}}\\s\\-_''.]', '', 'g'), '[\\s\\-_''.]+', '-', 'g'), '^-+|-+$', '', 'g') as s from people)""",
    "merged_names": f"""
with m as (select *, {_NORMAL.format('from_name')} as key, trim(from_name) as name from messages where trim(from_name) <> ''),
s as (select key, name, row_number() over (partition by key order by case when regexp_matches(name, '\\p{{Lu}}') and regexp_matches(name, '\\p{{Ll}}') then 2 when regexp_matches(name, '\\p{{Ll}}') then 1 else 0 end desc, count(*) desc, name) as r from m group by 1, 2),
f as (select key, array_to_string(list_sort(list(distinct lower(from_address))), ',') as mailboxes, cast(max(floor(epoch(ingested_at))) as bigint) as latest_s, count(distinct id) as mails from m group by 1)
select f.*, s.name from f join s on f.key = s.key and s.r = 1""",
}
