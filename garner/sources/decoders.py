"""Readers of foreign records: mail parts, address lists, post dumps and run logs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from email.header import decode_header
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without text, and elements that begin a line.
SILENT = {"head", "script", "style"}
BLOCKS = {"address", "article", "blockquote", "br", "div", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
#: Character sets tried in turn when a part names none or a wrong one.
CHARSETS = ("utf-8", "cp1252", "latin-1")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS and not self.silent:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS and tag != "br" and not self.silent:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_text(markup: str | None) -> str | None:
    """Text of a mail's HTML part: blocks on lines of their own, no blank lines in a row; null stays null."""
    if markup is None:
        return None
    parser = _Text()
    parser.feed(markup)
    parser.close()
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in "".join(parser.parts).replace("\r", "").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def part_text(data: bytes | None, charset: str | None = None) -> str | None:
    """Text of a mail part: its own character set if that works, else the first of ``CHARSETS`` that does."""
    if data is None:
        return None
    for name in (charset, *CHARSETS):
        try:
            return bytes(data).decode(name or "ascii")
        except (LookupError, UnicodeDecodeError):
            continue
    return bytes(data).decode("utf-8", "replace")


def header_text(value: str | None) -> str | None:
    """A header with its encoded words decoded; what can't be decoded stays as it is."""
    if value is None:
        return None
    try:
        return "".join(p if isinstance(p, str) else part_text(p, c) for p, c in decode_header(value)).strip()
    except Exception:  # noqa: BLE001 - malformed headers of any kind
        return value.strip()


def text_column(df: DataFrame, column: str, name: str, convert: Callable[[str | None], str | None]) -> DataFrame:
    """``df`` with ``convert`` of a text column, Arrow batch by batch."""
    schema = T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [convert(x if isinstance(x, str) else None) for x in b[column]]})[schema.names]

    return df.mapInPandas(run, schema)


def split_addresses(header: Column) -> Column:
    """An address header as an array of (name, address): commas inside quotes or angle brackets don't divide."""
    parts = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r'((?:"[^"]*"|<[^>]*>|[^,"<])+)'), F.lit(1))
    angle = lambda p: F.regexp_extract(p, r"<\s*([^<>]*?)\s*>", 1)
    made = F.transform(
        F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""),
        lambda p: F.struct(
            F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>?", ""), '^"|"$', "")).alias("raw"), F.lower(F.when(angle(p) != "", angle(p)).otherwise(p)).alias("address")
        ),
    )
    shown = lambda r: F.trim(F.regexp_replace(r["raw"], r'^\s*"|"\s*$', ""))
    return F.transform(made, lambda r: F.struct(F.when(F.lower(shown(r)) == r["address"], "").otherwise(shown(r)).alias("name"), r["address"].alias("address")))


def read_dump(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of a post dump: files that assign a JSON array to a script variable, unwrapped.

    ``element`` is the schema of an array's element in DDL.
    """
    lines = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"^\s*window\.[\w.$]+\s*=\s*", "")
    return lines.select(F.explode(F.from_json(body, f"array<{element}>")).alias("row")).select("row.*")


# Fixed value: form of a run-log line.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) +(INFO|WARN|ERROR|DEBUG) +([^ ]+) +([^ ]+) +([a-z][a-z0-9_]*): (.*)$"


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, level, run_id, command, event, message) of lines in the run log's form; others are left out."""
    names = ("at", "level", "run_id", "command", "event", "message")
    got = lines.where(F.col(column).rlike(LOG_LINE)).select(*[F.regexp_extract(column, LOG_LINE, i + 1).alias(n) for i, n in enumerate(names)])
    return got.withColumn("at", F.try_to_timestamp("at", F.lit("yyyy-MM-dd HH:mm:ss")))


def run_summaries(lines: DataFrame) -> DataFrame:
    """One row per run: command, first and last time, lines, errors and the last event."""
    return lines.groupBy("run_id").agg(
        F.min_by("command", "at").alias("command"),
        F.min("at").alias("started"),
        F.max("at").alias("finished"),
        F.count("*").alias("lines"),
        F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"),
        F.max_by("event", F.struct("at", "event")).alias("last_event"),
    )
