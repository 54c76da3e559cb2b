"""Queries of the general training-data problems, with their SQL where DuckDB can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import is_canonical, with_utc_ms
from garner.operators.history import attribute_hash, versions_from_sightings
from garner.sources.tables import table

#: field, table, key, value, zone column
TIME_FIELDS = (
    ("calendar_events.start_time", "calendar_events", "event_uid", "start_time", "start_tz"),
    ("note_versions.modified_at", "note_versions", "observation_id", "modified_at", "device_tz"),
    ("chats.last_message_at", "chats", "source_rowid", "last_message_at", None),
    ("messages.internal_date_ms", "messages", "id", "internal_date_ms", None),
)


def written_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every time value of the archive as (field, record_key, value, zone), one row per row."""
    parts = []
    for field, name, key, value, zone in TIME_FIELDS:
        df = table(spark, folder, name, key, value, *([zone] if zone else []))
        parts.append(
            df.select(
                F.lit(field).alias("field"),
                F.col(key).cast("string").alias("record_key"),
                F.col(value).cast("string").alias("value"),
                (F.col(zone) if zone else F.lit(None).cast("string")).alias("zone"),
            )
        )
    return reduce(DataFrame.unionByName, parts).where("record_key is not null and value is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of the records whose time is written in another form than the canonical one.

    Repeated rows of a record count once; should their values differ, the earliest instant is
    taken. Rows without a key belong to no record. The aggregation also keeps the filter on the
    result from being pushed below the parser, where it would repeat the whole parse.
    """
    parsed = with_utc_ms(written_times(spark, folder), "value", "zone")
    in_ms = (F.col("field") == "messages.internal_date_ms") & (F.col("value") == F.col("utc_ms").cast("string"))
    other = F.when(~is_canonical(F.col("value")) & ~in_ms, F.col("utc_ms"))
    return parsed.groupBy("field", "record_key").agg(F.min(other).alias("utc_ms")).where("utc_ms is not null")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of every note's text with the period in which each was valid."""
    rows = table(spark, folder, "note_versions", "observation_id", "note_id", "text", "text_status", "first_observed_at")
    rows = rows.where(F.coalesce("text_status", F.lit("")) != "unsupported").select(
        "note_id", "observation_id", "first_observed_at", attribute_hash(F.col("text")).alias("state"), (F.coalesce(F.col("text_status") == "missing", F.lit(False)) | F.col("text").isNull()).alias("absent")
    )
    rows = rows.groupBy("note_id", "observation_id").agg(F.min(F.struct("first_observed_at", "state", "absent")).alias("v")).select("note_id", "observation_id", "v.*")
    made = versions_from_sightings(rows, "note_id", "observation_id", "first_observed_at", "state", "absent")
    return made.select(
        "note_id", "version_no", F.unix_seconds("valid_from").alias("valid_from_s"), F.coalesce(F.unix_seconds("valid_to"), F.lit(0).cast("long")).alias("valid_to_s")
    )


QUERIES = {"p1_found": p1_found, "p7_found": p7_found}

SQL = {
    "p7_found": r"""
with once as (
  select note_id, observation_id, min(first_observed_at) as seen_at,
         min(regexp_replace(text, '\s+', '', 'g')) as state,
         bool_or(text_status = 'missing' or text is null) as absent
  from note_versions where text_status is distinct from 'unsupported' and note_id is not null
  group by 1, 2),
marked as (
  select *, lag(absent) over w as pa, lag(state) over w as ps, row_number() over w as n
  from once window w as (partition by note_id order by seen_at, observation_id)),
changes as (
  select * from marked where n = 1 or absent <> pa or (not absent and state is distinct from ps)),
closed as (
  select *, lead(seen_at) over (partition by note_id order by seen_at, observation_id) as until from changes)
select note_id,
       cast(row_number() over (partition by note_id order by seen_at, observation_id) as integer) as version_no,
       cast(floor(epoch(seen_at)) as bigint) as valid_from_s,
       cast(coalesce(floor(epoch(until)), 0) as bigint) as valid_to_s
from closed where not absent""",
}
