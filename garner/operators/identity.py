"""Identity over several records: matches that are unique, keys that tell nobody apart, and groups they made by mistake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_match(records: DataFrame, others: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(record, person): the other record each one shares a key with, if it shares keys with exactly one.

    Null keys match nothing; repeated rows change nothing.
    """
    right = others.select(*keys, F.col(record).alias("person")).distinct()
    met = records.select(record, *keys).distinct().join(right, keys)
    return met.groupBy(record).agg(F.count_distinct("person").alias("n"), F.min("person").alias("person")).where("n = 1").select(record, "person")


def ambiguous_keys(rows: DataFrame, keys: list[str], source: str, record: str) -> DataFrame:
    """Keys that several records of one source have, as a household's number: they tell nobody apart."""
    per_source = rows.groupBy(*keys, source).agg(F.count_distinct(record).alias("n"))
    return per_source.groupBy(*keys).agg(F.max("n").alias("n")).where("n > 1").select(*keys)


def repaired_groups(rows: DataFrame, ambiguous: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(keys, record, stays) of the groups that ambiguous keys made: a record stays if keys of its own link it with every other of its group.

    Members meet through the keys they share, never as all pairs of a group.
    """
    members = rows.join(ambiguous, keys, "left_semi").select(*keys, record).distinct()
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size"))
    own = rows.join(ambiguous, keys, "left_anti").select(record, *[F.col(k).alias(f"own_{k}") for k in keys]).distinct()
    held = members.join(own, record)
    other = held.select(*keys, *[f"own_{k}" for k in keys], F.col(record).alias("other"))
    linked = held.join(other, [*keys, *[f"own_{k}" for k in keys]]).where(F.col(record) != F.col("other"))
    linked = linked.groupBy(*keys, record).agg(F.count_distinct("other").alias("linked"))
    out = members.join(sizes, keys).join(linked, [*keys, record], "left")
    return out.select(*keys, record, (F.coalesce("linked", F.lit(0)) == F.col("size") - 1).alias("stays"))
