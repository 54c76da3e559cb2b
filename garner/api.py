"""The archive as its users ask it: search, who, conversations, messages, open, status, people, notes, calendar, posts."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import with_utc_ms
from garner.functions.matching import match_rank
from garner.functions.text import first_shown, mail_key, phone_key
from garner.operators.aliases import build, compose_link, lookup_table
from garner.operators.fulltext import marked, matches, runs, terms, tokens
from garner.operators.store import Store
from garner.operators.windows import context, latest, top_per_source
from garner.session import cut
from garner.sources.tables import table

APPLE_S = 978_307_200
SOURCES = ("chats", "mails", "posts", "notes", "calendar")
MATCH = ["source", "key", "at", "who", "title", "text"]


class UnknownPerson(ValueError):
    """Nobody fits the name."""


class AmbiguousPerson(ValueError):
    """Several people fit the name, or one only by a close spelling; ``candidates`` lists them."""

    def __init__(self, message: str, candidates: list[tuple[str, str, int]]) -> None:
        super().__init__(message)
        self.candidates = candidates


def parse_date(value: str, end: bool = False, zone: dt.tzinfo = dt.UTC) -> dt.datetime:
    """A date as users enter it: RFC 3339, ``Y-M-D h:m:s``, ``Y-M-D h:m`` or ``Y-M-D``.

    With ``end`` it is the last microsecond of the day, minute or second entered; RFC 3339 stays exact.
    """
    text = value.strip()
    steps = (("%Y-%m-%d %H:%M:%S", dt.timedelta(seconds=1)), ("%Y-%m-%d %H:%M", dt.timedelta(minutes=1)), ("%Y-%m-%d", dt.timedelta(days=1)))
    if re.match(r"^\d{4}-\d\d-\d\d[Tt]", text):
        made = dt.datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
        if made.tzinfo is None:
            raise ValueError(f"{value!r} has no zone")
        return made.astimezone(dt.UTC)
    for form, step in steps:
        try:
            made = dt.datetime.strptime(text, form).replace(tzinfo=zone)
        except ValueError:
            continue
        return (made + step - dt.timedelta(microseconds=1) if end else made).astimezone(dt.UTC)
    raise ValueError(f"{value!r} is no date")


class Archive:
    """Access to one folder of tables. Methods return DataFrames; limits below 1 are refused.

    With a ``store``, ``update`` keeps the records, their word index and their aliases there, and
    links are opened through the aliases kept.
    """

    def __init__(self, spark: SparkSession, folder: str, store: Store | None = None) -> None:
        self.spark, self.folder, self.store = spark, folder, store

    def update(self, seen: str, sources: tuple[str, ...] = SOURCES) -> DataFrame:
        """Merge each source's records into the store as a complete snapshot taken at ``seen``: (source, change, n).

        Every source is published by itself: one that fails leaves its last version in force.
        """
        if self.store is None:
            raise ValueError("an update needs a store")
        changes = []
        for s in sources:
            rows = cut(self.records(s).where("key is not null"))
            changes.append(self.store.apply_snapshot(s, rows, "key", seen).select(F.lit(s).alias("source"), "change", "n"))
            self.store.index_texts(s, rows, "key", "text")
            self.store.update_aliases(rows.select(F.concat(F.lit(f"{s}/"), "key").alias("r")), "r")
        return reduce(DataFrame.unionByName, changes)

    def _t(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    # -- records of each source in the common form --

    def _chats(self) -> DataFrame:
        m = self._t("chat_messages", "chat_rowid", "message_rowid", "handle_rowid", "date", "is_from_me", "text", "ingested_at")
        m = m.groupBy("message_rowid").agg(F.min_by(F.struct("chat_rowid", "handle_rowid", "date", "is_from_me", "text"), F.struct("chat_rowid", "ingested_at")).alias("v")).select("message_rowid", "v.*")
        h = latest(self._t("handles", "source_rowid", "display_name", "handle"), ["source_rowid"], ["handle"])
        c = latest(self._t("chats", "source_rowid", "name", "jid"), ["source_rowid"], ["jid"]).select(F.col("source_rowid").alias("c"), first_shown(F.col("name"), F.col("jid")).alias("title"))
        j = m.join(h, m["handle_rowid"] == h["source_rowid"], "left").join(c, F.col("chat_rowid") == F.col("c"), "left")
        who = F.when(F.col("is_from_me"), "me").otherwise(F.coalesce(first_shown(F.col("display_name"), F.col("handle")), F.lit("them")))
        at = F.when(F.col("date") > 0, F.timestamp_micros(F.floor(F.col("date") / 1000).cast("long") + APPLE_S * 1_000_000))
        person = F.when(F.col("handle").contains("@"), mail_key(F.col("handle"))).otherwise(phone_key(F.col("handle")))
        return j.select(F.lit("chats").alias("source"), F.col("message_rowid").cast("string").alias("key"), at.alias("at"), who.alias("who"), "title", "text", person.alias("person"), F.col("chat_rowid").cast("string").alias("conversation"))

    def _mails(self) -> DataFrame:
        m = latest(self._t("messages", "id", "thread_id", "internal_date_ms", "from_name", "from_address", "subject", "body", "ingested_at"), ["id"], ["ingested_at"])
        m = with_utc_ms(m, "internal_date_ms", None, "ms")
        return m.select(F.lit("mails").alias("source"), F.col("id").alias("key"), F.timestamp_millis("ms").alias("at"), first_shown(F.col("from_name"), F.col("from_address")).alias("who"), F.col("subject").alias("title"), F.col("body").alias("text"), mail_key(F.col("from_address")).alias("person"), F.col("thread_id").alias("conversation"))

    def _posts(self) -> DataFrame:
        t = latest(self._t("tweets", "id", "created_at", "author_handle", "author_name", "text", "conversation_id", "ingested_at"), ["id"], ["ingested_at"])
        return t.select(F.lit("posts").alias("source"), F.col("id").alias("key"), F.col("created_at").alias("at"), first_shown(F.col("author_name"), F.col("author_handle")).alias("who"), F.lit(None).cast("string").alias("title"), "text", F.lower("author_handle").alias("person"), F.coalesce("conversation_id", "id").alias("conversation"))

    def _notes(self) -> DataFrame:
        v = self._t("note_versions", "note_id", "observation_id", "title", "text", "text_status", "first_observed_at").where("text_status = 'decoded'")
        v = latest(v, ["note_id"], ["first_observed_at", "observation_id"])
        return v.select(F.lit("notes").alias("source"), F.col("note_id").alias("key"), F.col("first_observed_at").alias("at"), F.lit(None).cast("string").alias("who"), "title", "text", F.lit(None).cast("string").alias("person"), F.lit(None).cast("string").alias("conversation"))

    def _calendar(self) -> DataFrame:
        e = latest(self._t("calendar_events", "event_uid", "start_time", "start_tz", "summary", "description", "organizer_name", "organizer_email", "ingested_at"), ["event_uid"], ["ingested_at"])
        e = with_utc_ms(e, "start_time", "start_tz", "ms")
        return e.select(F.lit("calendar").alias("source"), F.col("event_uid").alias("key"), F.timestamp_millis("ms").alias("at"), first_shown(F.col("organizer_name"), F.col("organizer_email")).alias("who"), F.col("summary").alias("title"), F.col("description").alias("text"), mail_key(F.col("organizer_email")).alias("person"), F.lit(None).cast("string").alias("conversation"))

    def records(self, source: str) -> DataFrame:
        """Records of one of ``SOURCES``: source, key, at, who, title, text, person, conversation."""
        if source not in SOURCES:
            raise ValueError(f"no source {source!r}")
        return getattr(self, f"_{source}")()

    # -- operations --

    def status(self) -> DataFrame:
        """Records and newest time per source."""
        return reduce(DataFrame.unionByName, [self.records(s).groupBy("source").agg(F.count("*").alias("records"), F.max("at").alias("newest")) for s in SOURCES])

    def who(self, name: str, limit: int = 20) -> DataFrame:
        """People who fit a name: id, name, rank, mails and messages, most active first; direct fits hide close spellings."""
        _positive(limit)
        p = latest(self._t("people", "id", "name", "updated_at"), ["id"], ["updated_at"]).withColumn("rank", match_rank(F.lit(name), F.col("name"))).where("rank is not null")
        top = p.agg(F.max("rank")).first()[0]
        p = p.where("rank > 1") if top and top > 1 else p
        keys = self._identifiers().join(p.select("id"), "id", "left_semi")
        active = self._mails().select("person", "key").unionByName(self._chats().select("person", "key")).where("person is not null")
        counts = keys.join(active, keys["value"] == active["person"]).groupBy("id").agg(F.count_distinct("key").alias("messages"))
        out = p.join(counts, "id", "left").select("id", "name", "rank", F.coalesce("messages", F.lit(0)).alias("messages"))
        return out.orderBy(F.desc("messages"), F.desc("rank"), F.lower("name"), "id").limit(limit)

    def _identifiers(self) -> DataFrame:
        v = self._t("contact_values", "person_id", "kind", "value").where("kind in ('phone', 'email', 'handle') and trim(value) <> ''")
        key = F.when(F.col("kind") == "email", mail_key(F.col("value"))).when(F.col("kind") == "phone", phone_key(F.col("value"))).otherwise(F.lower(F.regexp_replace(F.trim("value"), "^@", "")))
        return v.select(F.col("person_id").alias("id"), key.alias("value")).where("length(value) >= 3").distinct()

    def resolve(self, name: str) -> str:
        """Id of the one person who fits; raises when nobody or several do, or one only by a close spelling."""
        fits = latest(self._t("people", "id", "name", "updated_at"), ["id"], ["updated_at"]).withColumn("rank", match_rank(F.lit(name), F.col("name"))).where("rank is not null")
        # counted over everyone who fits: only the list shown of an ambiguous name is limited
        ranks = {r["rank"]: (r["n"], r["id"]) for r in fits.groupBy("rank").agg(F.count("*").alias("n"), F.min("id").alias("id")).collect()}
        if not ranks:
            raise UnknownPerson(f"nobody fits {name!r}")
        if ranks.get(4, (0, ""))[0] == 1:
            return ranks[4][1]
        direct = {r: v for r, v in ranks.items() if r > 1}
        if sum(n for n, _ in direct.values()) == 1:
            return next(iter(direct.values()))[1]
        few = [(r["id"], r["name"], r["rank"]) for r in self.who(name, 5).collect()]
        if not direct and ranks[1][0] == 1:
            raise AmbiguousPerson(f"did you mean {few[0][1]!r}?", few)
        raise AmbiguousPerson(f"several people fit {name!r}", few)

    def _of_person(self, rows: DataFrame, person: str | None) -> DataFrame:
        if person is None:
            return rows
        keys = self._identifiers().where(F.col("id") == person).select(F.col("value").alias("person"))
        return rows.join(keys, "person", "left_semi")  # small, which the planner sees at run time

    def search(self, words: str = "", sources: tuple[str, ...] = SOURCES, limit: int = 20, after: str | None = None, before: str | None = None, who: str | None = None) -> DataFrame:
        """Newest matches over sources: ``MATCH`` columns, the text as runs with the matched words marked.

        Chats, posts and calendar take phrases, mails and notes single words. Without words a
        person or a bound is needed. Bounds are inclusive; ``before`` reaches to the end of what
        was entered.
        """
        _positive(limit)
        low, high = parse_date(after) if after else None, parse_date(before, end=True) if before else None
        if not words.strip() and who is None and low is None and high is None:
            raise ValueError("words, a person or a bound are needed")
        if low and high and low > high:
            raise ValueError("after is later than before")
        person = self.resolve(who) if who else None
        parts = []
        for s in sources:
            phrases = tokens(words) if s in ("mails", "notes") else terms(words)
            rows = self._of_person(self.records(s), person)
            if words.strip():
                rows = rows.where(matches([F.col("title"), F.col("text")], phrases))
            rows = rows.where(F.col("at") >= F.lit(low)) if low else rows
            rows = rows.where(F.col("at") <= F.lit(high)) if high else rows
            single = sorted({w for p in phrases for w in p.split()})
            shown = runs(marked(F.col("text"), single)) if single else F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("matched")))
            parts.append(rows.withColumn("text", shown).select(*MATCH))
        return top_per_source(parts, [F.desc_nulls_last("at"), F.col("source"), F.col("key")], limit)

    def conversations(self, who: str | None = None, unread: bool = False, limit: int | None = 50) -> DataFrame:
        """Chats, mail threads and post threads with their messages and newest time, newest first, those without a time last."""
        person = self.resolve(who) if who else None
        rows = reduce(DataFrame.unionByName, [self._of_person(self.records(s), person) for s in ("chats", "mails", "posts")]).where("conversation is not null")
        out = rows.groupBy("source", "conversation").agg(F.count("*").alias("messages"), F.max("at").alias("newest"), F.max_by("title", "at").alias("title"))
        if unread:
            c = self._t("chats", "source_rowid", "unread_count").where("unread_count > 0").select(F.lit("chats").alias("source"), F.col("source_rowid").cast("string").alias("conversation")).distinct()
            m = self._t("messages", "thread_id", "is_unread").where("is_unread").select(F.lit("mails").alias("source"), F.col("thread_id").alias("conversation")).distinct()
            out = out.join(c.unionByName(m), ["source", "conversation"], "left_semi")
        out = out.orderBy(F.desc_nulls_last("newest"), "source", "conversation")
        return out if limit is None else out.limit(_positive(limit))

    def messages(self, source: str, conversation: str, limit: int = 50) -> DataFrame:
        """Messages of one conversation, newest first, with how many there are."""
        rows = self.records(source).where(F.col("conversation") == conversation)
        total = rows.count()
        return rows.orderBy(F.desc_nulls_last("at"), F.desc("key")).limit(_positive(limit)).select(*MATCH, F.lit(total).alias("total"))

    def links(self, source: str) -> DataFrame:
        """Short link of every record of a source: key, link."""
        held = self.store.read("aliases") if self.store is not None else None
        e = build(self.records(source).select(F.concat(F.lit(f"{source}/"), "key").alias("r")), "r") if held is None else held.where(F.col("full_ref").startswith(f"{source}/"))
        return e.select(F.expr("substring(full_ref, instr(full_ref, '/') + 1)").alias("key"), compose_link(F.lit(source), F.col("alias")).alias("link"))

    def open(self, link: str, around: int = 5) -> DataFrame:
        """The record of a link and its neighbours in its conversation: ``MATCH`` columns, offset, more_before, more_after."""
        source, _, alias = link.partition(":")
        rows = self.records(source)
        if self.store is not None:
            e = self.store.references(alias)
        else:
            built = build(rows.select(F.concat(F.lit(f"{source}/"), "key").alias("r")), "r")
            e = [r["full_ref"] for r in lookup_table(built).where(F.col("alias") == alias).limit(2).collect()]
        if len(e) != 1:
            raise LookupError(f"{link} is {'ambiguous' if e else 'unknown'}")
        key = e[0].partition("/")[2]
        one = rows.where(F.col("key") == key).select("conversation").first()["conversation"]
        if one is None:
            return rows.where(F.col("key") == key).select(*MATCH, F.lit(0).alias("offset"), F.lit(False).alias("more_before"), F.lit(False).alias("more_after"))
        talk = rows.where(F.col("conversation") == one)
        return context(talk, ["conversation"], ["at", "key"], F.col("key") == key, around, around).select(*MATCH, F.col("offset").cast("int").alias("offset"), "more_before", "more_after").orderBy("offset")

    def people(self, query: str | None = None, limit: int = 50) -> DataFrame:
        """People, all or those who fit a name, by name."""
        p = latest(self._t("people", "id", "name", "relationship_context", "updated_at"), ["id"], ["updated_at"]).drop("updated_at")
        rank: Column = match_rank(F.lit(query), F.col("name")) if query else F.lit(0)
        return p.withColumn("rank", rank).where("rank is not null").orderBy(F.desc("rank"), F.lower("name"), "id").limit(_positive(limit))

    def note_versions(self, note: str, at: str | None = None) -> DataFrame:
        """Decoded sightings of a note, newest first, or the one in force at a moment."""
        v = self._t("note_versions", "note_id", "observation_id", "title", "text", "text_status", "first_observed_at").distinct().where((F.col("note_id") == note) & (F.col("text_status") == "decoded"))
        order = [F.desc("first_observed_at"), F.desc("observation_id")]
        return v.orderBy(*order) if at is None else v.where(F.col("first_observed_at") <= F.lit(parse_date(at, end=True))).orderBy(*order).limit(1)

    def post_stats(self, now: str, days: int = 30, by: str = "like_count", limit: int = 10) -> DataFrame:
        """Posts of the days before a moment with the largest metric, ties by id."""
        if by not in ("like_count", "retweet_count", "reply_count"):
            raise ValueError(f"no metric {by!r}")
        end = parse_date(now, end=True)
        t = latest(self._t("tweets", "id", "created_at", "author_handle", "text", by, "ingested_at"), ["id"], ["ingested_at"])
        young = t.where(F.col("created_at").between(F.lit(end - dt.timedelta(days=days)), F.lit(end)) & F.col(by).isNotNull())
        return young.orderBy(F.desc(by), F.desc("id")).limit(_positive(limit)).drop("ingested_at")


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError("a limit must be at least 1")
    return limit
