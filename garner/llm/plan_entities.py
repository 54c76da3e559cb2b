"""People of the address books that are one person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.llm.entities import json_strings, matched_pairs, one_person_each, person_classes, profiles, same_person_pairs, straighten, told_apart
from garner.session import cut
from garner.sources.tables import table


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row per key; of differing repeats the smallest."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("v")).select(key, "v.*")


def person_records(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of people with their values, contacts and handles."""
    values = table(spark, folder, "contact_values", "person_id", "kind", "value").where("kind in ('phone', 'email', 'handle') and trim(value) <> ''")
    gathered = values.groupBy("person_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(f"v_{k}") for k in ("phone", "email", "handle")])
    people = _once(table(spark, folder, "people", "id", "name", "sort_name", "aka_json", "accounts_json", "relationship_context"), "id")
    people = people.join(gathered, people["id"] == gathered["person_id"], "left").drop("person_id")
    contacts = _once(table(spark, folder, "contacts", "jid", "phone", "full_name", "first_name", "last_name", "business_name", "username", "about_text"), "jid")
    handles = _once(table(spark, folder, "handles", "source_rowid", "handle", "uncanonicalized_id", "display_name"), "source_rowid")

    def listed(v) -> list[str]:
        return [] if v is None else [x for x in v if x]

    def person(r: dict) -> dict:
        return {
            "rec": f"people:{r['id']}", "name": r["name"], "sort_name": r["sort_name"], "aka": json_strings(r["aka_json"]), "phones": listed(r["v_phone"]),
            "mails": listed(r["v_email"]), "accounts": listed(r["v_handle"]) + json_strings(r["accounts_json"]), "remarks": [r["relationship_context"]],
        }

    def contact(r: dict) -> dict:
        name = r["full_name"] or " ".join(x for x in (r["first_name"], r["last_name"]) if x)
        hint = f"{r['last_name']} {r['first_name']}" if r["last_name"] and r["first_name"] else None
        if not hint and name and r["first_name"] and len(r["first_name"].strip(".")) > 1 and name.strip()[:1].lower() == r["first_name"][:1].lower() and "." in name.split()[0]:
            name = r["first_name"] + " " + " ".join(name.split()[1:])
        return {"rec": f"contacts:{r['jid']}", "name": name, "sort_name": hint, "phones": listed([r["phone"]]), "accounts": listed([r["username"]]), "remarks": [r["about_text"], r["business_name"]]}

    def handle(r: dict) -> dict:
        both = listed([r["handle"], r["uncanonicalized_id"]])
        return {"rec": f"handles:{r['source_rowid']}", "name": r["display_name"], "phones": both, "mails": both}

    raw = profiles(people, "people", person).unionByName(profiles(contacts, "contacts", contact)).unionByName(profiles(handles, "handles", handle))
    return straighten(raw)


def _matched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(matched pairs of records that are told apart; rec, same of all records)."""
    records = cut(told_apart(person_records(spark, folder)))
    return matched_pairs(records.where("rec = same").drop("same")), records.select("rec", "same")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of different tables that are one person."""
    matches, repeats = _matched(spark, folder)
    return same_person_pairs(cut(one_person_each(matches)), repeats)


def p2_people(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every record that is matched with another: ``p2_found`` without classes expanded into pairs."""
    matches, repeats = _matched(spark, folder)
    return person_classes(cut(one_person_each(matches)), repeats)


def p2_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Directly matched pairs with their calibrated confidence."""
    matches, repeats = _matched(spark, folder)
    for side in ("a", "b"):
        matches = matches.withColumnRenamed(side, "same").join(repeats.withColumnRenamed("rec", side), "same").drop("same")
    return matches.select("a", "b", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p2_found": p2_found, "p2_people": p2_people, "p2_confidence": p2_confidence}
SQL: dict[str, str] = {}
