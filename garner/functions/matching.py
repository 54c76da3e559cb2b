"""How well a written name fits a query: exact, prefix, substring or close spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garner.functions.text import base_letters, compact, normalised

EXACT, PREFIX, SUBSTRING, CLOSE = 4, 3, 2, 1


def adjacent_swap(a: Column, b: Column) -> Column:
    """Whether two texts of equal length differ by one swap of neighbours."""
    n = F.length(a)
    swaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)))
    return F.when((n == F.length(b)) & (n >= 2) & (a != b), F.array_contains(swaps, b)).otherwise(False)


def close_spelling(a: Column, b: Column) -> Column:
    """Three letters or more, the same first letter without its marks, and an edit distance that grows with length, or one swap."""
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.when(longest <= 8, 1).when(longest <= 12, 2).otherwise(3)
    first = lambda c: F.substring(base_letters(F.regexp_replace(c, r"[^\p{L}]", "")), 1, 1)
    fits = (F.length(a) >= 3) & (F.length(b) >= 3) & (first(a) == first(b)) & (first(a) != "")
    return fits & ((F.levenshtein(a, b) <= allowed) | adjacent_swap(a, b))


def close_words(query: Column, value: Column) -> Column:
    """Every word of the query is, or is close to, some word of the value."""
    words = F.filter(F.split(value, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    wanted = F.filter(F.split(query, " "), lambda w: w != "")
    one = lambda q: F.exists(words, lambda w: (compact(q) == w) | close_spelling(compact(q), w))
    return (F.size(wanted) > 0) & F.forall(wanted, one)


def match_rank(query: Column, value: Column) -> Column:
    """Rank of ``value`` for ``query``; null when it doesn't fit or either shows no letter or digit."""
    q, v, qc, vc = normalised(query), normalised(value), compact(query), compact(value)
    rank = (
        F.when((q == v) | (qc == vc), EXACT)
        .when(v.startswith(q) | vc.startswith(qc), PREFIX)
        .when(v.contains(q) | vc.contains(qc), SUBSTRING)
        .when(close_spelling(qc, vc) | close_words(q, v), CLOSE)
    )
    return F.when((qc != "") & (vc != ""), rank)
