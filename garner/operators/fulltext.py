"""Full-text search: tokens, phrases, ranking and fragments.

Words are runs of letters, digits and marks, in lower case without Latin marks. A phrase of
several words needs them side by side. One query is one scan of the texts: the words of a text
become one padded line in which a phrase is a substring, so nothing is shuffled; ``postings`` is
the index for many queries over the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garner.functions.text import base_letters, collapse

OPEN, CLOSE = "\ue000", "\ue001"
_WORDS = r"[^\p{L}\p{N}\p{M}]+"


def word_line(text: Column) -> Column:
    """The words of a text, each between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(base_letters(F.coalesce(text, F.lit(""))), _WORDS, " ")), F.lit(" "))


def query_words(phrase: str) -> str:
    """A phrase in the form of ``word_line``, or '' when it has no word."""
    words = re.findall(r"[^\W_]+", phrase.lower())
    return f" {' '.join(words)} " if words else ""


def terms(query: str) -> list[str]:
    """Phrases of a query split at white space; a term with punctuation inside is a phrase of several words."""
    return [p for t in query.split() if (p := query_words(t))]


def tokens(query: str) -> list[str]:
    """Words of a query split at everything that is no letter, digit, mark or underscore; each is a phrase of its own."""
    return [p for t in re.findall(r"\w+", query) if (p := query_words(t))]


def matches(columns: list[Column], phrases: list[str], any_of: bool = False) -> Column:
    """Whether every phrase (or any) occurs in some of the columns; without phrases nothing matches."""
    if not phrases:
        return F.lit(False)
    out = None
    for p in phrases:
        one = F.lit(False)
        for c in columns:
            one = one | F.contains(word_line(c), F.lit(p))
        out = one if out is None else (out | one if any_of else out & one)
    return out


def postings(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, word): the inverted index of a text column, to be stored bucketed by word."""
    words = F.split(F.trim(word_line(F.col(column))), " ")
    return texts.select(key, F.posexplode(words).alias("place", "word")).where("word <> ''")


def phrase_hits(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, hits): documents of an index with the words side by side.

    Each word's postings move back by its place in the phrase; places at which all words meet are
    hits. One aggregation, whatever the length of the phrase.
    """
    at = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)]) if len(set(words)) == len(words) else None
    if at is None:
        parts = [index.where(F.col("word") == w).select(key, (F.col("place") - i).alias("start"), F.lit(i).alias("i")) for i, w in enumerate(words)]
        moved = parts[0]
        for p in parts[1:]:
            moved = moved.unionByName(p)
    else:
        moved = index.where(F.col("word").isin(words)).select(key, (F.col("place") - at[F.col("word")]).alias("start"), at[F.col("word")].alias("i"))
    starts = moved.groupBy(key, "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(words))
    return starts.groupBy(key).agg(F.count("*").alias("hits"))


def bm25(texts: DataFrame, key: str, column: str, phrases: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of texts with every phrase; larger is better.

    Frequencies of phrases and lengths come from one scan; document frequencies and the mean length
    are one row of sums. A phrase in more than half of the texts keeps a tiny weight.
    """
    line = word_line(F.col(column))
    n = lambda p: ((F.length("__line") - F.length(F.replace(F.col("__line"), F.lit(p), F.lit(" ")))) / (len(p) - 1)).cast("int")
    held = texts.select(key, line.alias("__line")).withColumns({f"f{i}": n(p) for i, p in enumerate(phrases)})
    held = held.withColumn("size", F.size(F.filter(F.split("__line", " "), lambda w: w != ""))).drop("__line")
    sums = held.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"d{i}") for i in range(len(phrases))]).first()
    score = F.lit(0.0)
    hit = F.lit(True)
    for i in range(len(phrases)):
        idf = F.greatest(F.log(F.lit((sums["n"] - sums[f"d{i}"] + 0.5) / (sums[f"d{i}"] + 0.5))), F.lit(1e-6))
        f = F.col(f"f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("size") / F.lit(float(sums["mean"] or 1))))
        hit = hit & (f > 0)
    return held.where(hit).select(key, score.alias("score"))


def marked(text: Column, words: list[str]) -> Column:
    """``text`` with marks around each whole word of the query, whatever its case."""
    any_word = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}\p{{M}}])({any_word})(?![\p{{L}}\p{{N}}\p{{M}}])", f"{OPEN}$1{CLOSE}")


def runs(shown: Column) -> Column:
    """Marked text as an array of (text, matched); null when a mark is not closed; empty runs are left out."""
    opened = F.length(shown) - F.length(F.replace(shown, F.lit(OPEN), F.lit("")))
    closed = F.length(shown) - F.length(F.replace(shown, F.lit(CLOSE), F.lit("")))
    pieces = F.split(shown, f"(?={OPEN})|(?<={CLOSE})")
    made = F.transform(pieces, lambda p: F.struct(F.translate(p, OPEN + CLOSE, "").alias("text"), p.startswith(OPEN).alias("matched")))
    return F.when(opened == closed, F.filter(made, lambda r: r["text"] != ""))


def fragment(text: str, query: str, size: int = 1000) -> str:
    """At most ``size`` characters of a text around the earliest whole word of the query, cut between words."""
    shown = " ".join(text.split())
    if len(shown) <= size:
        return shown
    at = None
    for w in dict.fromkeys(re.findall(r"\w+", query.lower())):
        m = re.search(rf"(?<!\w){re.escape(w)}(?!\w)", shown, re.IGNORECASE)
        if m and (at is None or m.start() < at[0]):
            at = m.span()
    start = 0
    if at:
        start = min(max(at[0] - (size - (at[1] - at[0])) // 2, 0), len(shown) - size)
        if start and shown[start - 1] != " ":
            ahead = shown.find(" ", start, at[0])
            start = ahead + 1 if ahead >= 0 else shown.rfind(" ", 0, start) + 1 or start
    end = min(start + size, len(shown))
    if end < len(shown) and shown[end - 1] != " ":
        back = shown.rfind(" ", at[1] if at else 0, end)
        end = back if back > start else end
    return shown[start:end].strip()


def fragments(texts: DataFrame, key: str, column: str, query: str, size: int = 1000) -> DataFrame:
    """(key, fragment) for every text that is not null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "fragment": [fragment(t, query, size) for t in b[column]]})

    kind = dict(texts.dtypes)[key]
    return texts.where(F.col(column).isNotNull()).select(key, column).mapInPandas(run, f"{key} {kind}, fragment string")


def lead(text: Column, size: int = 5) -> Column:
    """The last ``size`` characters before a match, from a whole word on, with a leading ellipsis when something is left out."""
    flat = F.regexp_replace(text, r"\s+", " ")
    tail = F.regexp_replace(F.substring(flat, F.lit(-size), F.lit(size)), r"^\S*(?= )", "")
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.lit("…"), F.ltrim(tail)))


__all__ = ["bm25", "collapse", "fragment", "fragments", "lead", "marked", "matches", "phrase_hits", "postings", "query_words", "runs", "terms", "tokens", "word_line"]
