"""Containers and mixtures of the archive's documents, measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garner.llm.mixing import drawn_documents, shares
from garner.llm.packing import packed, usage
from garner.llm.tokens import with_token_counts
from garner.session import cut, spread
from garner.sources.tables import table


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens) of every document with a text."""
    rows = table(spark, folder, "documents", "doc_id", "source", "text")
    return with_token_counts(spread(rows, "doc_id"), ["doc_id", "source"])


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every text and the unused room, for every capacity."""
    items = cut(sized_documents(spark, folder).select("doc_id", "tokens"))
    return packed(items, table(spark, folder, "container_specs", "spec", "capacity_tokens"))


def p8_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused room per capacity."""
    return usage(p8_containers(spark, folder))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn to the target shares, in training order."""
    return drawn_documents(sized_documents(spark, folder), table(spark, folder, "source_targets", "source", "target_share", "max_repeats"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached per source."""
    drawn, demand = drawn_documents(sized_documents(spark, folder), table(spark, folder, "source_targets", "source", "target_share", "max_repeats"))
    return shares(drawn, demand)


QUERIES = {"p8_containers": p8_containers, "p8_usage": p8_usage, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
