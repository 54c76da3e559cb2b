"""Write-side merges, as joins and aggregations over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garner.functions.text import blank_to_null


def fingerprint(*columns: Column) -> Column:
    """Digest of a row's values; null and empty differ."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, changed, unchanged or deleted between two complete snapshots, one row per key in each."""
    a = old.select(key, fingerprint(*[F.col(c) for c in columns]).alias("__a"))
    b = new.select(key, fingerprint(*[F.col(c) for c in columns]).alias("__b"))
    met = a.join(b, key, "full")
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "deleted").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return met.select(key, change.alias("change"))


def merge_columns(old: DataFrame, new: DataFrame, key: str, texts: list[str], counters: list[str]) -> DataFrame:
    """Upsert by column: a blank new text keeps the old one, counters keep the larger value; absence is no deletion."""
    b = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in (*texts, *counters)])
    met = old.join(b, old[key] == b["__k"], "full")
    merged = [F.coalesce(blank_to_null(F.col(f"__{c}")), F.col(c)).alias(c) for c in texts]
    merged += [F.greatest(F.col(c), F.col(f"__{c}")).alias(c) for c in counters]
    return met.select(F.coalesce(F.col(key), F.col("__k")).alias(key), *merged)


def fold_duplicates(rows: DataFrame, key: str, order: list[str], texts: list[str], counters: list[str], flags: list[str]) -> DataFrame:
    """One row per key: the first text that is not blank in ``order``, the largest counter, any flag."""
    place = F.struct(*order)
    first = [F.min_by(blank_to_null(F.col(c)), F.when(blank_to_null(F.col(c)).isNotNull(), place)).alias(c) for c in texts]
    return rows.groupBy(key).agg(*first, *[F.max(c).alias(c) for c in counters], *[F.max(c).alias(c) for c in flags])


def content_versions(sightings: DataFrame, entity: str, text: str, first: str, last: str) -> DataFrame:
    """Content-addressed versions: one row per entity and digest, with first and latest sighting and their number."""
    rows = sightings.where(F.col(text).isNotNull()).withColumn("digest", F.sha2(F.col(text), 256))
    return rows.groupBy(entity, "digest").agg(F.min(first).alias("first_seen"), F.max(last).alias("latest_seen"), F.count("*").alias("sightings"))


def pending(manifest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a manifest that were not ingested with the same keys and digest."""
    return manifest.join(done.select(*keys).distinct(), keys, "left_anti")


def source_state(sightings: DataFrame, entity: str, at: str, missing: Column) -> DataFrame:
    """(entity, state, first_missing): current, or deleted upstream since the first missing sighting after the last present one."""
    rows = sightings.withColumn("__gone", F.coalesce(missing, F.lit(False)))
    seen = rows.groupBy(entity).agg(F.max(F.when(~F.col("__gone"), F.col(at))).alias("last_present"))
    late = rows.where("__gone").join(seen, entity).where(F.col("last_present").isNull() | (F.col(at) > F.col("last_present")))
    gone = late.groupBy(entity).agg(F.min(at).alias("first_missing"))
    out = seen.join(gone, entity, "left")
    return out.select(entity, F.when(F.col("first_missing").isNull(), "current").otherwise("deleted_upstream").alias("state"), "first_missing")


def is_stale(updated: Column, now: Column, most_s: int) -> Column:
    """Missing is stale; without a limit nothing else is; beyond the limit it is."""
    if most_s <= 0:
        return updated.isNull()
    return updated.isNull() | (F.unix_seconds(now) - F.unix_seconds(updated) > most_s)


def refresh_or_insert(stored: DataFrame, snapshot: DataFrame, key: str, current_snapshot: bool) -> DataFrame:
    """``stored`` after a snapshot of the same columns: a current one refreshes what it holds, a historical one only adds what is missing; absence is no deletion."""
    first, second = (snapshot, stored) if current_snapshot else (stored, snapshot)
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def changed_since(before: DataFrame, now: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, change) of entities that are new or whose marks differ from the look before; null marks equal null marks."""
    old = before.select(key, *[F.col(m).alias(f"__{m}") for m in marks], F.lit(True).alias("__there"))
    met = now.select(key, *marks).join(old, key, "left")
    same = F.col("__there").isNotNull()
    for m in marks:
        same = same & F.col(m).eqNullSafe(F.col(f"__{m}"))
    return met.where(~same).select(key, F.when(F.col("__there").isNull(), "new").otherwise("changed").alias("change"))


def work_queue(wanted: DataFrame, done: DataFrame, keys: list[str], due: Column) -> DataFrame:
    """(keys, reason): new work that nothing finished covers, and finished work for which ``due`` holds."""
    new = wanted.join(done.select(*keys), keys, "left_anti").select(*keys, F.lit("new").alias("reason"))
    return new.unionByName(wanted.select(*keys).join(done.where(due).select(*keys), keys, "left_semi").select(*keys, F.lit("refresh").alias("reason")))


def capped_claims(asked: DataFrame, group: list[str], item: str, at: str, cap: int) -> DataFrame:
    """The first ``cap`` claims of each group by time and item, numbered from 1; a repeated item claims once.

    The cap is the feature. Each group keeps at most ``cap`` rows per block before groups are put together.
    """
    once = asked.groupBy(*group, item).agg(F.min(at).alias(at))
    salted = once.withColumn("__salt", F.pmod(F.xxhash64(item), F.lit(64)))
    order = [F.col(at), F.col(item)]
    few = salted.withColumn("claim", F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))).where(F.col("claim") <= cap).drop("__salt")
    return few.withColumn("claim", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("claim") <= cap)
