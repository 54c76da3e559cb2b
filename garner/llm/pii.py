"""Personal items inside free text.

Anchor expansion: one Aho-Corasick automaton finds at-signs, schemes, digits, street words and cues
of identity numbers, another the first names. Each hit starts a local parser that expands to the
boundaries of the item, left and right as far as its form goes, and validates it. First names come
from the archive's own name columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words that stand in streets, by the way the address is built.
STREET_END = "Street St Str Road Rd Lane Ln Avenue Ave Boulevard Blvd Court Ct Drive Dr Drv Square Sq Place Way Terrace Crescent Close Row Gardens Hill".split()
STREET_HEAD = "rue avenue av. boulevard bd place pl. chemin ch. quai impasse allée cours calle avenida plaza paseo via".split()
STREET_TAIL = "straße strasse str. str weg gasse platz allee straat laan plein gracht".split()
#: Words before a number that say what it counts.
NOT_PERSONAL = r"(?:meeting(?: id)?|serial(?: no\.?)?|order(?: no\.?)?|tracking|ticket|invoice|passcode|pin|version|booking|seat|room|gate|parcel|isbn|model|size|shade|total|page|rechnung|bestellung|auftrag|commande|facture|pedido|factura)\W*$"
ID_CUES = (
    "passport", "id card", "identity", "tax id", "tax number", "social security", "national insurance", "insurance", "insurance card", "card says", "dni", "nie",
    "visa", "ausweis", "steuer", "versicherung", "documento", "pasaporte", "numéro", "carte", "passeport", "nummer", "card", "for the form", "id:",
)

# A blank inside an item may be a line break with quote marks.
_SP = r"(?:[ \t ]+|[ \t]*\r?\n[ \t>|]*)"
_CAP = r"[A-ZÀ-ÖØ-ÞĀĆČĎĐĘĚĞİĶŁŃŇŐŒŘŚŞŠŤŮŰŹŻŽ]"
_TOWN = rf"(?:(?:Bad|St\.?|San|Saint|New|Le|La) )?{_CAP}[^\W\d_]+(?:-{_CAP}[^\W\d_]+)*"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Whg\.?|Wohnung|appt\.?|bât\.?|#)" + rf"{_SP}?[0-9A-Za-z]{{1,5}}"
_UKCODE = r"[A-Z]{1,2}[0-9]{1,2}[A-Z]? ?[0-9][A-Z]{2}"
_PLACE = rf"(?:(?:[A-Z]{{1,2}}-)?\d{{5}}{_SP}{_TOWN}|{_TOWN}(?:,?{_SP}[A-Z]{{2}}\b)?(?:,?{_SP}(?:\d{{5}}(?!\d)|{_UKCODE}))?|{_UKCODE})"
_ENGLISH = re.compile(
    rf"(?:{_FLAT},{_SP})?\b\d{{1,5}}[A-Za-z]?{_SP}(?:(?:[NSEW]\.?|North|South|East|West){_SP})?(?:{_CAP}[\w'’]*{_SP}){{1,3}}(?:{'|'.join(STREET_END)})\b\.?(?:,{_SP}{_FLAT})?(?:,{_SP}{_PLACE})?"
)
_ROMANCE = re.compile(
    rf"(?:{_FLAT},{_SP})?\b\d{{1,5}}(?:{_SP}?(?:bis|ter|[a-dA-D]))?,?{_SP}(?:{'|'.join(map(re.escape, STREET_HEAD))}){_SP}(?:(?:de la|de los|de las|du|des|del|de l['’]|de|d['’]){_SP}?)?(?:l['’])?{_CAP}[\w'’]*(?:{_SP}(?:de |du |des )?{_CAP}[\w'’]*){{0,3}}(?:,{_SP}{_FLAT})*(?:,{_SP}{_PLACE})?"
)
_GERMANIC = re.compile(
    rf"(?:{_CAP}[\w\-]{{2,}}(?:{'|'.join(map(re.escape, STREET_TAIL))})|{_CAP}[\w\-]+[ \-](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee)){_SP}\d{{1,4}}(?:{_SP}?[a-d]\b)?(?:,{_SP}(?:\d\. OG|EG|Hinterhaus|{_FLAT}))?(?:,{_SP}{_PLACE}|{_SP}in{_SP}{_TOWN})?"
)
_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"]+")
_HANDLE = re.compile(r"(?<![\w.])@\w+")
_HOUSE = re.compile(r"\d{1,5}[A-Za-z]?")
_ID = re.compile(
    rf"(?<![\w\-])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{2}}{_SP}\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}|\d{{8}}[A-Z]|[A-Z]\d{{7}}[A-Z]|[A-Z]{{2}}{_SP}\d{{2}}{_SP}\d{{2}}{_SP}\d{{2}}{_SP}[A-D]|[A-Z]{{2}}\d{{6}}[A-D]|[A-Z]{{2}}-\d{{4}}-\d{{5}}|[A-Z]\d{{2}}[A-Z]\d{{2}}[A-Z]\d{{3}}|[A-Z]\d{{8}})(?![\w]|-\d)"
)
_PHONE_START = re.compile(r"(?<![\w.+\-/])(?:\+\d{1,3}|00\d{2}|\(\d{3,5}\)|0\d{2,5}|1[\-. ]\d{3}|\d{3}[.\-]\d{3})(?!\d)")
_PHONE_LINE = re.compile(r"(?:[ .\-/]?\(?\d+\)?)*")
_PHONE_WRAP = re.compile(rf"(?:(?:[.\-/]|{_SP})?\(?\d+\)?)*")
_NAME = re.compile(rf"(?<![\w@#&/.\-'’])({_CAP}[^\W\d_A-Z]+(?:-{_CAP}?[^\W\d_]+)?)")
_SECOND = re.compile(rf"(?:[  ]+|(\r?\n)[ \t>|]*)({_CAP}(?:[^\W\d_]|['’](?={_CAP}))+(?:-{_CAP}[^\W\d_]+)?)")
_NOT_SECOND = set("The This That And Or But If In On At To Mon Tue Wed Thu Fri Sat Sun Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Tel Phone Mail Und Der Die Das El Le Les Dial Gate Meeting Ticket Order Invoice Room Serial Tracking Version We You They".split())
_FOLLOW = re.compile(rf"{_SP}([^\W\d_]+)")
#: Words behind a capitalised word that show it to be a verb or noun.
_VERB_OBJECT = set("the a an you we they it he she i my your his her our their this that these those there be all any some not".split())


@cache
def _automaton() -> ahocorasick.Automaton:
    """Anchors with the parser each one starts and the length of the anchor's word."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for w in ("://", "www."):
        a.add_word(w, ("url", len(w)))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for w in STREET_END:
        for before in " \n":
            a.add_word(before + w.lower(), ("english", len(w)))
    for w in STREET_HEAD:
        for after in " \n":
            a.add_word(w.lower() + after, ("romance", len(w) + 1))
    for w in STREET_TAIL:
        for after in " \n\r":
            a.add_word(w.lower() + after, ("germanic", len(w) + 1))
    for w in ID_CUES:
        a.add_word(w, ("cue", len(w)))
    a.make_automaton()
    return a


def name_automaton(words: list[str]) -> ahocorasick.Automaton | None:
    """Anchors of first names, or None if there are none."""
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    if not words:
        return None
    a.make_automaton()
    return a


class Taken:
    """Spans of a text that are used up, merged and in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        """Whether nothing of start to end is used up."""
        k = bisect_right(self.starts, start)
        return (k == 0 or self.ends[k - 1] <= start) and (k == len(self.starts) or self.starts[k] >= end)

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


_BLANK = set(" \t\u00a0\u202f\r\n>|")


def _back_blanks(text: str, at: int) -> int:
    """Start of the blanks, line breaks and quote marks that end before ``at``."""
    while at > 0 and text[at - 1] in _BLANK:
        at -= 1
    return at


def _back_token(text: str, at: int) -> int:
    """Start of the run of other characters that ends before ``at``."""
    while at > 0 and text[at - 1] not in _BLANK:
        at -= 1
    return at


def _words_before(low: str, start: int) -> str:
    """The last two words before ``start`` with what stands behind them, blanks collapsed."""
    at = start
    for _ in range(2):
        while at > 0 and not low[at - 1].isalnum():
            at -= 1
        while at > 0 and low[at - 1].isalnum():
            at -= 1
    return re.sub(r"[\s>|]+", " ", low[at:start])


def _mail_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Mailbox around the at-sign at ``at``; its local part starts at ``least`` or later."""
    domain = _DOMAIN.match(text, at)
    if not domain:
        return None
    start = at
    while start > least and (text[start - 1].isalnum() or text[start - 1] in "_.+-'"):
        start -= 1
    while start < at and text[start] in ".+-'":
        start += 1
    return (start, domain.end()) if start < at else None


def _number_starts(text: str, at: int) -> list[int]:
    """Places at which an identity number may start whose first digit group starts at ``at``: there, or at letters before it."""
    starts = [at]
    for end in {at, _back_blanks(text, at), at - 1 if text[at - 1 : at] == "-" else at}:
        for n in (1, 2):
            if end >= n and all("A" <= c <= "Z" for c in text[end - n : end]):
                starts.append(end - n)
    return sorted(starts)


def _cue_before(low: str, cues: list[int], start: int) -> bool:
    """Whether a cue of identity numbers stands before ``start`` in the same sentence."""
    k = bisect_left(cues, start) - 1
    return k >= 0 and not re.search(r"[.!?][\s>|]|\n[\s>|]*\n", low[cues[k] : start])


def _id_at(text: str, low: str, at: int, cues: list[int], taken: Taken) -> tuple[int, int] | None:
    for start in _number_starts(text, at):
        m = _ID.match(text, start)
        if m and taken.free(start, m.end()) and not re.search(NOT_PERSONAL, _words_before(low, start)):
            if not re.fullmatch(r"[A-Z]\d{8}", m[0]) or _cue_before(low, cues, start):
                return start, m.end()
    return None


def _phone_at(text: str, at: int) -> tuple[int, int] | None:
    """Phone number whose first digit group starts at ``at``, with the sign before it."""
    starts = (at - 1, at) if at and text[at - 1] in "+(" else (at,)
    for start in starts:
        m = _PHONE_START.match(text, start)
        if not m:
            continue
        end = _PHONE_LINE.match(text, m.end()).end()
        digits = sum(c.isdigit() for c in text[start:end])
        if digits < 10:  # the number may go on behind a line break
            end = _PHONE_WRAP.match(text, m.end()).end()
            digits = sum(c.isdigit() for c in text[start:end])
        return (start, end) if 9 <= digits <= 15 else None
    return None


def _address_starts(text: str, kind: str, at: int) -> list[int]:
    """Places at which an address may start whose street word starts at ``at``, the farthest first."""
    if kind == "germanic":  # the street word ends its token, or is one behind the name's
        start = at
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-"):
            start -= 1
        starts = [k for k in range(start, at + 1) if text[k : k + 1].isupper()][:1]
        if start == at and at:
            before = at - 1
            while before > 0 and (text[before - 1].isalnum() or text[before - 1] in "_-"):
                before -= 1
            starts = [k for k in range(before, at) if text[k].isupper()][:1] + starts
        return starts
    starts, place = [], at
    for _ in range(5 if kind == "english" else 2):  # a number, a direction and up to three words; a number and its letter
        end = _back_blanks(text, place)
        place = _back_token(text, end)
        if end == place:
            break
        number = next((k for k in range(place, end) if text[k].isdigit()), None)
        if number is not None and _HOUSE.match(text, number):
            starts.append(number)
            comma = _back_blanks(text, number)
            if comma and text[comma - 1] == ",":  # a flat may stand before the number
                flat = _back_token(text, comma)
                word = _back_token(text, _back_blanks(text, flat))
                starts += [flat + k for k in range(comma - flat) if text[flat + k].isupper() or text[flat + k] == "#"][:1] + [word + k for k in range(flat - word) if text[word + k].isalpha()][:1]
    return sorted(starts)


_ADDRESS = {"english": _ENGLISH, "romance": _ROMANCE, "germanic": _GERMANIC}


def find_items(text: str | None, first: ahocorasick.Automaton | None = None, every: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Certain items as (start, end, kind), and names as (start, end, first word).

    Names are those that start with a word of ``first``; with ``every``, all that start with a
    capitalised word, as candidates. Null and empty texts have none. Items don't overlap; e-mails
    win, then identity numbers, phone numbers and addresses.
    """
    if not text:
        return [], []
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, (what, size) in _automaton().iter(low):
        hits.setdefault(what, []).append((end + 1 - size, end + 1))
    spans: list[tuple[int, int, str]] = []
    taken, last = Taken(), 0
    for at, _ in hits.get("at", ()):
        got = _mail_at(text, at, last)
        if got:
            last = got[1]
            spans.append((*got, "email"))
            taken.add(*got)
        elif m := _HANDLE.match(text, at):
            taken.add(*m.span())
    for at, _ in hits.get("url", ()):
        start = next((at - n for n in (5, 4) if low[at] == ":" and text[max(0, at - n) : at] == "https"[:n]), at)
        if m := _URL.match(text, start):
            taken.add(*m.span())
    groups = [s for k, (s, _) in enumerate(digits) if not k or digits[k - 1][0] + 1 != s] if (digits := hits.get("digit")) else []
    cues = [end for _, end in hits.get("cue", ())]
    for at in groups:
        if got := _id_at(text, low, at, cues, taken):
            spans.append((*got, "id_number"))
            taken.add(*got)
    for at in groups:
        if (got := _phone_at(text, at)) and taken.free(*got) and not re.search(NOT_PERSONAL, _words_before(low, got[0])):
            spans.append((*got, "phone"))
            taken.add(*got)
    if groups:
        for kind in ("english", "romance", "germanic"):
            for at, end in hits.get(kind, ()):
                if (kind == "english" and low[end : end + 1].isalnum()) or (kind == "romance" and at and low[at - 1].isalnum()):
                    continue
                for start in _address_starts(text, kind, at):
                    m = _ADDRESS[kind].match(text, start)
                    if m and m.end() >= end - 1 and taken.free(*m.span()):
                        spans.append((*m.span(), "address"))
                        taken.add(*m.span())
                        break
    if first is not None:
        places = sorted({end + 1 - size for end, size in first.iter(text)})
    else:
        places = [m.start() for m in _NAME.finditer(text)] if every else []
    return sorted(spans), [got for at in places if (got := _name_at(text, at, taken))]


def _name_at(text: str, at: int, taken: Taken) -> tuple[int, int, str] | None:
    """Name whose first word starts at ``at``, with a last name if one follows."""
    m = _NAME.match(text, at)
    if not m or not taken.free(*m.span()):
        return None
    end = m.end()
    after = text[end : end + 1]
    if after and (after.isalnum() or after in "_@"):
        return None
    second = _SECOND.match(text, end)
    if second and second[2] not in _NOT_SECOND and taken.free(*second.span(2)):
        line = end - (text.rfind("\n", 0, m.start()) + 1)
        if not second[1] or line >= 48:
            word = re.sub(r"['’]s?$", "", second[2])
            end = second.end(2) - (len(second[2]) - len(word))
    if end == m.end():
        follow = _FOLLOW.match(text, end)
        if follow and follow[1].lower() in _VERB_OBJECT:
            return None
    return m.start(), end, m[1]


#: First names up to which the workers get all of them; beyond, capitalised words are joined to them.
MOST_NAMES = 50_000


def scan_texts(texts: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(field, record_key, start, end, kind, found_text, first) of items, and of names that start with a word of ``first``.

    Without ``first``, every capitalised word starts a candidate of a name. ``texts``: field,
    record_key, text. Whole texts are read; null texts give nothing.
    """
    shared = None if first is None else texts.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, listed = (None, None) if shared is None else (name_automaton(shared.value), set(shared.value))
        for b in batches:
            out = []
            for f, k, t in zip(b["field"], b["record_key"], b["text"], strict=True):
                spans, names = find_items(t, known, listed is None)
                out += [(f, k, s, e, kind, t[s:e], None) for s, e, kind in spans]
                out += [(f, k, s, e, "name", t[s:e], word) for s, e, word in names if listed is None or word in listed]
            yield pd.DataFrame(out, columns=["field", "record_key", "start", "end", "kind", "found_text", "first"])

    return texts.where("text is not null").mapInPandas(run, "field string, record_key string, start int, end int, kind string, found_text string, first string")


def first_names(names: DataFrame) -> DataFrame:
    """First names seen in name columns: the word ``first``.

    ``names``: source and name, one row per record. Of names of two capitalised words, a word
    counts when it stands first far more often than it stands last, so names in reverse order do
    no harm, and does so in two sources, before two last names, or in five records.
    """
    shape = rf"^{_CAP}[\p{{Ll}}]+(-[\p{{L}}]+)?$"
    pairs = names.groupBy("source", F.split(F.trim("name"), r"\s+").alias("w")).agg(F.count("*").alias("n"))
    pairs = pairs.where(F.size("w") == 2).where(F.forall("w", lambda x: x.rlike(shape)))
    sides = F.array(
        F.struct(F.col("w")[0].alias("word"), F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("n").alias("rows")),
        F.struct(F.col("w")[1].alias("word"), F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).cast("long").alias("rows")),
    )
    counts = pairs.select(F.explode(sides).alias("r")).groupBy("r.word").agg(F.sum("r.x").alias("x"), F.sum("r.y").alias("y"), F.sum("r.rows").alias("rows"))
    return counts.where("(x >= 2 or rows >= 5) and x > 2 * y").select(F.col("word").alias("first"))


def personal_items(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(field, record_key, start, end, kind, found_text) of every personal item.

    Up to ``MOST_NAMES`` first names go to the workers as anchors; more of them are joined to the
    capitalised words of the texts, with the same result.
    """
    firsts = first_names(names)
    few = firsts.limit(MOST_NAMES + 1).toPandas()["first"].tolist()
    if len(few) <= MOST_NAMES:
        return scan_texts(texts, sorted(few)).drop("first")
    # Rows without a first name get keys that occur once or so, as equal nulls would meet in one task.
    found = scan_texts(texts).withColumn("word", F.coalesce("first", F.concat_ws("#", "record_key", "start")))
    known = firsts.select(F.col("first").alias("word"), F.lit(True).alias("known"))
    return found.join(known, "word", "left").where("kind <> 'name' or known").drop("word", "first", "known")


def redact(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``texts`` with every item replaced by its typed placeholder; texts without items stay as they are."""
    spans = items.groupBy("field", "record_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    joined = texts.join(spans, ["field", "record_key"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans in zip(b["text"], b["spans"], strict=True):
                if t is None or spans is None:
                    out.append(t)
                    continue
                parts, at = [], 0
                for x in spans:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], PLACEHOLDER[x["kind"]]]
                        at = x["end"]
                out.append("".join([*parts, t[at:]]))
            yield pd.DataFrame({"field": b["field"], "record_key": b["record_key"], "redacted": out})

    return joined.mapInPandas(run, "field string, record_key string, redacted string")
