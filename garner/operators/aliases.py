"""Short stable aliases of long references."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Alphabet, hash prefix and lengths of aliases.
ALPHABET = "23456789abcdefghjkmnpqrstuvwxyz"
PREFIX = "sr1|"
LEAST, MOST, WHOLE = 5, 10, 52
COLLISIONS = 0.01


def encoded(reference: str) -> str:
    """All digits of the reference's hash in base 31, the low ones first."""
    value = int.from_bytes(hashlib.sha256((PREFIX + reference).encode()).digest(), "big")
    out = []
    for _ in range(WHOLE):
        value, digit = divmod(value, len(ALPHABET))
        out.append(ALPHABET[digit])
    return "".join(out)


def _with_code(refs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"full_ref": b["full_ref"], "code": b["full_ref"].map(encoded)})

    return refs.mapInPandas(run, "full_ref string, code string")


def default_length(n: int) -> int:
    """Shortest length at which a reference is expected to collide with less than a hundredth of another."""
    for length in range(LEAST, MOST + 1):
        if n <= 1 or (n - 1) / (2 * len(ALPHABET) ** length) <= COLLISIONS:
            return length
    return MOST


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning; 0 when either is null."""
    same = F.filter(F.sequence(F.lit(1), F.lit(WHOLE)), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.size(F.when(a.isNotNull() & b.isNotNull(), same)), F.lit(0))


def build(references: DataFrame, column: str) -> DataFrame:
    """(full_ref, alias) of the distinct references; independent of their order.

    References that share the default prefix are told apart by one character more than their
    longest common beginning, which sorted neighbours give: only colliding references meet.
    Null references are left out.
    """
    refs = references.where(F.col(column).isNotNull()).select(F.col(column).alias("full_ref")).distinct()
    start = default_length(refs.count())
    refs = _with_code(refs)
    w = Window.partitionBy(F.substring("code", 1, start)).orderBy("code")
    near = F.greatest(_common(F.col("code"), F.lag("code").over(w)), _common(F.col("code"), F.lead("code").over(w)))
    sized = refs.withColumn("near", near)
    size = F.when(F.col("near") >= start, F.col("near") + 1).otherwise(start)
    return sized.select("full_ref", F.substring(F.col("code"), F.lit(1), size).alias("alias"))


def lookup_table(entries: DataFrame) -> DataFrame:
    """(full_ref, alias) for every beginning of an alias of at least the least length."""
    at = F.explode(F.sequence(F.lit(LEAST), F.length("alias")))
    return entries.withColumn("n", at).select("full_ref", F.substring(F.col("alias"), F.lit(1), F.col("n")).alias("alias")).distinct()


def resolve(lookups: DataFrame, wanted: DataFrame) -> DataFrame:
    """(alias, state, full_ref) of wanted aliases: resolved, ambiguous or unknown."""
    got = wanted.select("alias").distinct().join(lookups, "alias", "left").groupBy("alias").agg(F.count("full_ref").alias("n"), F.min("full_ref").alias("full_ref"))
    state = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return got.select("alias", state.alias("state"), F.when(F.col("n") == 1, F.col("full_ref")).alias("full_ref"))


def compose_link(source: Column, alias: Column) -> Column:
    """A link over all sources, or null for an invalid alias or source."""
    fits = alias.rlike(f"^[{ALPHABET}]{{{LEAST},{WHOLE}}}$") & source.rlike("^[a-z][a-z0-9_]*$")
    return F.when(fits, F.concat(source, F.lit(":"), alias))


def parse_link(link: Column) -> Column:
    """Source and alias of a link; null when it has not that form."""
    form = rf"^([a-z][a-z0-9_]*):([{ALPHABET}]{{{LEAST},{WHOLE}}})$"
    return F.when(link.rlike(form), F.struct(F.regexp_extract(link, form, 1).alias("source"), F.regexp_extract(link, form, 2).alias("alias")))


def drop_absent(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Entries whose reference still occurs in a complete snapshot (column full_ref)."""
    return entries.join(present.select("full_ref").distinct(), "full_ref", "left_semi")
