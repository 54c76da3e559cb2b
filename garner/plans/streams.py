"""Streams over the archive, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.streaming.pages import drain, page_loop, stream_table, windowed_counts


def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type, counted by a stream; rows up to seven days late are counted, days still open at the end are not emitted."""
    e = stream_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    counts = drain(windowed_counts(e, "at", ["event_type"], "1 day", "7 days"), spark, "windows")
    return counts.select(F.unix_seconds("window.start").alias("day_s"), "event_type", "n")


def paged_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts read page by page; the newest row of each counts."""
    t = stream_table(spark, folder, "tweets").select("id", "author_id", "ingested_at")
    rows, _ = page_loop(t, spark, "id", "ingested_at", "posts")
    return rows.select("id", "author_id", F.unix_seconds("ingested_at").alias("seen_s"))


def page_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows read over all pages and the last cursor."""
    t = stream_table(spark, folder, "tweets").select("id", "ingested_at")
    _, cursors = page_loop(t, spark, "id", "ingested_at", "cursors")
    return cursors.agg(F.sum("rows_read").alias("rows_read"), F.max(F.unix_seconds("cursor")).alias("cursor_s"))


QUERIES = {f.__name__: f for f in (streamed_windows, paged_posts, page_cursors)}

SQL = {
    "streamed_windows": """
with e as (select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as day_s, event_type from events), m as (select max(epoch(ts)) as newest from events)
select day_s, event_type, count(*) as n from e, m where day_s + 8 * 86400 <= newest group by 1, 2""",
    "paged_posts": "select id, arg_max(author_id, ingested_at) as author_id, cast(floor(epoch(max(ingested_at))) as bigint) as seen_s from tweets group by 1",
    "page_cursors": "select count(*) as rows_read, cast(floor(epoch(max(ingested_at))) as bigint) as cursor_s from tweets",
}
