"""Mails of the archive reduced to what their senders newly wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.instants import with_utc_ms
from garner.llm.mail_text import long_threads, message_lines, message_new_lines
from garner.sources.tables import table


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """One row per mail: id, thread, at, sender, body; of repeated rows the smallest body counts."""
    rows = table(spark, folder, "messages", "id", "thread_id", "internal_date_ms", "from_name", "body").where("id is not null")
    rows = with_utc_ms(rows, "internal_date_ms", None, "at")
    one = rows.groupBy("id").agg(F.min(F.struct("body", F.col("thread_id").alias("thread"), "at", F.col("from_name").alias("sender"))).alias("v"))
    return one.select("id", "v.*")


def _hot(spark: SparkSession, folder: str) -> DataFrame:
    """Threads too long for one task, judged by their rows with repeats."""
    return long_threads(table(spark, folder, "messages", "thread_id", "body").select(F.col("thread_id").alias("thread"), "body"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Newly written non-blank lines of every mail."""
    return message_new_lines(mails(spark, folder), _hot(spark, folder))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines by what tells that they are new or old."""
    return message_lines(mails(spark, folder), _hot(spark, folder)).groupBy("path").agg(F.count("*").alias("lines"))


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths}
SQL: dict[str, str] = {}
