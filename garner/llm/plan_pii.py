"""Personal items in the archive's free texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.llm.pii import personal_items, redact
from garner.session import cut, spread
from garner.sources.tables import table

TEXT_FIELDS = (
    ("messages.body", "messages", "id", "body"),
    ("note_versions.text", "note_versions", "observation_id", "text"),
    ("calendar_events.description", "calendar_events", "event_uid", "description"),
    ("tweets.text", "tweets", "id", "text"),
)
NAME_FIELDS = (
    ("people", "name"),
    ("contacts", "full_name"),
    ("tweets", "author_name"),
    ("messages", "from_name"),
    ("participants", "display_name"),
    ("calendar_events", "organizer_name"),
    ("handles", "display_name"),
)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, record_key, text), one row per record; of differing repeats the smallest text counts."""
    parts = [
        table(spark, folder, name, key, column).select(F.lit(field).alias("field"), F.col(key).cast("string").alias("record_key"), F.col(column).alias("text"))
        for field, name, key, column in TEXT_FIELDS
    ]
    rows = reduce(DataFrame.unionByName, parts).where("record_key is not null and trim(text) <> ''")
    return spread(rows.groupBy("field", "record_key").agg(F.min("text").alias("text")), "field", "record_key")


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the archive's name columns."""
    return reduce(DataFrame.unionByName, [table(spark, folder, t, c).select(F.lit(t).alias("source"), F.col(c).alias("name")) for t, c in NAME_FIELDS]).where("name is not null")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct personal items of every record."""
    return personal_items(texts(spark, folder), names(spark, folder)).select("field", "record_key", "kind", "found_text").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in place of its personal items."""
    rows = texts(spark, folder)
    return redact(rows, cut(personal_items(rows, names(spark, folder)).select("field", "record_key", "start", "end", "kind")))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
SQL: dict[str, str] = {}
