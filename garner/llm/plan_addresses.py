"""Address records of the archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.llm.addresses import member_pairs, place_classes
from garner.session import cut
from garner.sources.tables import table


def address_records(spark: SparkSession, folder: str) -> DataFrame:
    """(key, address) of every record that has an address column; repeated rows count once."""
    events = table(spark, folder, "calendar_events", "event_uid", "location_address")
    values = table(spark, folder, "contact_values", "person_id", "kind", "position", "value").where("kind = 'address'")
    guests = table(spark, folder, "participants", "event_uid", "position", "address")
    parts = [
        events.select(F.concat(F.lit("calendar_events:"), "event_uid").alias("key"), F.col("location_address").alias("address")),
        values.select(F.concat(F.lit("contact_values:"), "person_id", F.lit(":"), F.col("position").cast("string")).alias("key"), F.col("value").alias("address")),
        guests.select(F.concat(F.lit("participants:"), "event_uid", F.lit(":"), F.col("position").cast("string")).alias("key"), "address"),
    ]
    rows = reduce(DataFrame.unionByName, parts).where("key is not null and trim(address) <> ''")
    return rows.groupBy("key").agg(F.min("address").alias("address"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose addresses denote the same place."""
    return member_pairs(cut(place_classes(address_records(spark, folder))), "place")


def p4_places(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every record with a postal address: ``p4_found`` without copies expanded into pairs."""
    return place_classes(address_records(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_places": p4_places}
SQL: dict[str, str] = {}
