"""Documents that hold template residue or error text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garner.llm.residue import residue_records
from garner.sources.tables import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text shows that no real content arrived."""
    return residue_records(table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that stay once those with residue are left out."""
    documents = table(spark, folder, "documents", "doc_id", "source", "lang", "n_chars")
    return documents.join(p10_found(spark, folder), "doc_id", "left_anti")


QUERIES = {"p10_found": p10_found, "p10_kept": p10_kept}
SQL: dict[str, str] = {}
