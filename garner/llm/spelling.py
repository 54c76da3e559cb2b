"""Spelling slips: bounded edit distance and correction towards the usual spelling of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def damerau(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours, or ``limit`` + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, usual, usual_n) of different words one slip apart, each in both orders. ``words``: word, n.

    Neighbours share one of the forms that come from leaving out a letter, so all words within one
    insertion, deletion, substitution or swap are met without comparing all pairs.
    """
    drops = F.expr("transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))")
    keyed = words.where("word <> ''").select("word", "n", F.explode(F.array_distinct(F.concat(drops, F.array("word")))).alias("form"))
    usual = keyed.select("form", F.col("word").alias("usual"), F.col("n").alias("usual_n"))
    met = keyed.join(usual, "form").where("word <> usual").distinct()
    swap = (F.length("word") == F.length("usual")) & (F.levenshtein("word", "usual") == 2)
    met = met.where((F.levenshtein("word", "usual") <= 1) | (swap & (F.sort_array(F.split("word", "")) == F.sort_array(F.split("usual", "")))))
    return met.select("word", "n", "usual", "usual_n").distinct()


def canonical_words(rows: DataFrame, column: str, ratio: float = 3.0, least: int = 4) -> DataFrame:
    """``rows`` with words of ``column`` replaced by the usual spelling one slip away.

    Counts are taken over all rows. A word moves to its most frequent neighbour that is at least
    ``ratio`` times as frequent. Words shorter than ``least`` or with digits stay.
    """
    words = rows.groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n")).where(f"length(word) >= {least} and not word rlike '[0-9]'")
    met = near_words(words).where(F.col("usual_n") >= ratio * F.col("n"))
    best = met.groupBy("word").agg(F.max_by("usual", F.struct("usual_n", "usual")).alias("usual"))
    return rows.join(best, rows[column] == best["word"], "left").withColumn(column, F.coalesce("usual", column)).drop("word", "usual")
