"""Text expressions shared by the plans; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose base letter is not given by decomposition, and marked Latin letters, by base letter.
MARKED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"


def blank_to_null(c: Column) -> Column:
    """Null for text that is empty or blank, else the text without outer blanks."""
    return F.when(F.trim(c) != "", F.trim(c))


def first_shown(*columns: Column) -> Column:
    """First of the columns that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalised(c: Column) -> Column:
    """Lower case with collapsed white space; marks stay."""
    return F.lower(collapse(c))


def compact(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def base_letters(c: Column) -> Column:
    """Lower case with Latin marks taken off."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def looks_like_phone(c: Column) -> Column:
    """At least five digits and nothing but digits and phone signs."""
    return c.rlike(r"^[0-9 +()\-.]+$") & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 5)


def case_quality(c: Column) -> Column:
    """2 for mixed case, 1 for lower case alone, 0 otherwise."""
    upper, lower = c.rlike(r"\p{Lu}"), c.rlike(r"\p{Ll}")
    return F.when(upper & lower, 2).when(lower, 1).otherwise(0)


def is_identifier_like(c: Column, *identifiers: Column) -> Column:
    """Blank, without a letter, or equal to an identifier."""
    same = F.lit(False)
    for i in identifiers:
        same = same | F.coalesce(F.lower(F.trim(c)) == F.lower(F.trim(i)), F.lit(False))
    return F.coalesce((F.trim(c) == "") | ~c.rlike(r"\p{L}") | same, F.lit(True))


def human_name(c: Column, *identifiers: Column) -> Column:
    """The name if it may be shown for a person, else null: no blank, dots, 'unknown', number or identifier."""
    shown = blank_to_null(c)
    bad = F.lower(shown).isin("...", "…", "unknown") | looks_like_phone(shown) | is_identifier_like(shown, *identifiers)
    return F.when(~bad, shown)


def mail_key(c: Column) -> Column:
    """Mailbox without scheme and outer blanks, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"^(?i)mailto:", "")))


# Country codes behind which a trunk zero is dropped.
TRUNK_ZERO = ("31", "44", "49", "33", "39", "34", "46", "47", "45", "32", "43", "41", "48")


def phone_key(c: Column) -> Column:
    """Digits of a number, without leading 00, and without the trunk zero behind a listed country code when 6 to 12 digits follow it."""
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^00", "")
    return F.regexp_replace(digits, "^(" + "|".join(TRUNK_ZERO) + ")0(?=[0-9]{6,12}$)", "$1")


def slug(c: Column) -> Column:
    """Letters and digits in lower case joined by dashes; 'person' when nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{Nd}\s\-_'.]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s\-_'.]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "person").otherwise(dashed)


def shorten(c: Column, size: int) -> tuple[Column, Column]:
    """Text cut to ``size`` characters, and whether it was cut."""
    return F.substring(c, 1, size), F.length(c) > size


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlap; 100 when the text is the word."""
    low = F.lower(text)
    n = (F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / F.lit(len(word))
    return F.when(F.trim(low) == word.lower(), 100).otherwise(n.cast("int"))
