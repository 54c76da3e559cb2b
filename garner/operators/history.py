"""Validity periods of entity attributes, built from sightings or merged update by update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garner.operators.segments import BLOCK, blocks, neighbour, running

MISSING = "missing"


def attribute_hash(*values: Column) -> Column:
    """Digest of attributes that ignores white space; a null attribute differs from an empty one."""
    shown = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(v.cast("string"), r"[\p{IsWhite_Space}]+", "")), F.lit("-")) for v in values]
    return F.xxhash64(F.sha2(F.concat_ws("\u0001", *shown), 256))


def versions_from_sightings(sightings: DataFrame, entity: str, tie: str, at: str, state: str, absent: str) -> DataFrame:
    """Type-two history from sightings.

    ``state`` is the attribute hash of a sighting and ``absent`` whether the entity was found
    missing. Sightings of an entity are taken in the order of (``at``, ``tie``). A sighting opens a
    version when its hash differs from the one before it, or when it follows a missing sighting;
    the version is closed by the next sighting that differs or is missing.

    Returns entity, version_no, valid_from, valid_to (null while open). Entities may hold any share
    of the rows. Null entities and null times are left out; an empty input gives an empty result.
    """
    rows = sightings.select(entity, tie, at, state, F.coalesce(absent, F.lit(False)).alias("absent")).where(
        F.col(entity).isNotNull() & F.col(at).isNotNull()
    )
    order = [at, tie]
    tagged = blocks(rows, [entity], order)
    seen = neighbour(tagged, [entity], order, ["absent", state], "prev_")
    changes = seen.where(
        ~F.col("prev_exists")
        | (F.col("absent") != F.col("prev_absent"))
        | (~F.col("absent") & ~F.col(state).eqNullSafe(F.col(f"prev_{state}")))
    ).select(entity, tie, at, "absent", BLOCK)
    # Only rows that change something are left: the next change closes a version.
    closed = neighbour(changes, [entity], order, [at], "next_", after=True)
    numbered = running(closed, [entity], order, F.when(~F.col("absent"), 1).otherwise(0), "version_no").where(~F.col("absent"))
    return numbered.select(entity, F.col("version_no").cast("int").alias("version_no"), F.col(at).alias("valid_from"), F.col(f"next_{at}").alias("valid_to"))


def merge_type_two(current: DataFrame, updates: DataFrame, entity: str, at: str, attributes: list[str]) -> DataFrame:
    """One merge of a batch of updates (one row per entity) into a history.

    ``current`` has entity, attributes, attribute_hash, valid_from and valid_to. An open row whose
    hash differs from its update is closed at the update's time and a new open row is added; equal
    hashes leave it as it is; entities not yet known get a first row; entities without an update
    stay. Updates older than the open row's start, null entities and null times are ignored.
    """
    fresh = updates.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(
        F.col(entity).alias("__entity"), F.col(at).alias("__at"), attribute_hash(*[F.col(a) for a in attributes]).alias("__hash"), *[F.col(a).alias(f"__{a}") for a in attributes]
    )
    shut, live = current.where("valid_to is not null"), current.where("valid_to is null")
    met = live.join(fresh, live[entity] == fresh["__entity"], "full")
    known, new = F.col(entity).isNotNull(), F.col("__entity").isNotNull()
    changed = known & new & (F.col("attribute_hash") != F.col("__hash")) & (F.col("__at") >= F.col("valid_from"))
    old_row = F.struct(entity, *attributes, "attribute_hash", "valid_from", F.when(changed, F.col("__at")).alias("valid_to"))
    new_row = F.struct(
        F.col("__entity").alias(entity), *[F.col(f"__{a}").alias(a) for a in attributes], F.col("__hash").alias("attribute_hash"), F.col("__at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")
    )
    kept = met.select(F.explode(F.filter(F.array(F.when(known, old_row), F.when(changed | ~known, new_row)), lambda r: r.isNotNull())).alias("r")).select("r.*")
    return shut.select(kept.columns).unionByName(kept)
