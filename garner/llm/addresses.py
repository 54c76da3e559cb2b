"""Postal addresses that denote the same place.

An address is taken apart into house number, street and town. Streets and towns become weighted
character n-grams; candidates come from an inverted index on the rarest n-grams of each address
(prefix filter), keyed by house number as well; cosine similarity and a check of the parts decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from garner.llm.spelling import canonical_words, damerau, near_words
from garner.operators.components import connected_components
from garner.session import cut, spread

# Street types by the words that stand for them.
TYPES = {
    "street": "street st str strasse straße",
    "road": "road rd",
    "lane": "lane ln la",
    "avenue": "avenue ave av",
    "boulevard": "boulevard blvd boul bd bld",
    "court": "court ct crt",
    "drive": "drive dr drv",
    "square": "square sq sqr",
    "place": "place pl platz plaza",
    "way": "way wy",
    "close": "close cl",
    "terrace": "terrace ter terr",
    "crescent": "crescent cres",
    "rue": "rue r",
    "chemin": "chemin ch chem",
    "quai": "quai",
    "impasse": "impasse imp",
    "weg": "weg",
    "gasse": "gasse",
    "allee": "allee allée",
    "ufer": "ufer",
    "ring": "ring",
    "damm": "damm",
}
COUNTRIES = r"united states of america|united states|united kingdom|great britain|deutschland|germany|allemagne|france|frankreich|england|scotland|wales|u\.s\.a\.?|u\.k\.?|usa|uk|gb|fr|de|us"
UNITS = r"flat|unit|apt|apartment|suite|ste|room|rm|whg|wohnung|appt|appartement|app|bat|batiment|bt|esc|escalier|etage|floor|fl|top|tuer"
CONNECTORS = {"de", "du", "des", "la", "le", "les", "l", "d", "der", "den", "am", "an", "im", "zum", "zur"}
DIRECTIONS = {"n": "n", "s": "s", "e": "e", "w": "w", "north": "n", "south": "s", "east": "e", "west": "w", "nord": "n", "sued": "s", "sud": "s", "ost": "e", "est": "e", "ouest": "w"}
FRENCH = {"rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse", "allee", "square"}
COMPOUND = ("strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm")

_TYPE_OF = {word: kind for kind, words in TYPES.items() for word in words.split()}
_COMPOUND_OF = {"strasse": "street", "str": "street", "platz": "place"}
_UK = re.compile(r"(?<![a-z0-9])([a-z]{1,2}[0-9]{1,2}[a-z]?) ?([0-9][a-z]{2})(?![a-z0-9])")
_ZIP = re.compile(r"(?<![a-z0-9.])(?:[a-z]{1,2}-)?([0-9]{5})(?:-[0-9]{4})?(?![0-9.a-z])")
_NOT_POSTAL = re.compile(r"://|@|^\s*-?[0-9]+\.[0-9]+\s*,\s*-?[0-9]+\.[0-9]+\s*$")
_UNIT = re.compile(rf"(?<![a-z0-9])(?:(?:{UNITS})\b\.? *#? *(?:[0-9]+ ?[a-z]?|[a-z])(?![a-z0-9])|# *[0-9]+[a-z]?|[0-9]+\. *(?:og|ug|stock|etage|floor)\b\.?|[0-9]+(?:st|nd|rd|th|e|er|eme) (?:floor|etage)|(?:og|eg|ug|dg)(?![a-z0-9])|erdgeschoss|dachgeschoss|hinterhaus|vorderhaus|rueckgebaeude|ground floor|first floor|second floor)")
_CARE = re.compile(r"(?<![a-z0-9])(?:c/o|z\.? ?h(?:d|nd)\.?|attn\.?:?|care of)\s+")
_COUNTRY = re.compile(rf"(?:^|(?<=[|\s]))(?:{COUNTRIES})(?=$|\s*\|)")
_TRAILING_COUNTRY = re.compile(rf"[\s|]+(?:{COUNTRIES})[\s|.]*$")
FIELDS = ("house", "kind", "side", "street", "town", "code")


def fold(text: str) -> str:
    """Lower case without marks; both ways of writing an umlaut become the plain vowel."""
    text = text.lower().replace("ß", "ss").replace("’", "'").replace("`", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _plain(word: str) -> str:
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _compound(word: str) -> tuple[str, str, bool] | None:
    """Stem and type of a word such as 'lindenstrasse'; the last flag tells a spelling slip in the type."""
    for end in COMPOUND:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)], _COMPOUND_OF.get(end, end), False
    best = None
    for end in COMPOUND:
        if end in ("str", "ring", "ufer", "damm"):
            continue
        for size in (len(end), len(end) - 1, len(end) + 1):
            if len(word) - size >= 3 and damerau(word[-size:], end, 1) <= 1:
                cand = (word[:-size], _COMPOUND_OF.get(end, end), True)
                if best is None:
                    best = cand
    if best is None and len(word) >= 6 and re.search(r"(?:srt|sttr|strr|sstr|tsr|rst|tr|sr)$", word):
        best = (re.sub(r"(?:srt|sttr|strr|sstr|tsr|rst|tr|sr)$", "", word), "street", True)
    return best


def _direction(word: str) -> str:
    if word in DIRECTIONS:
        return DIRECTIONS[word]
    return next((d[0] for d in ("north", "south", "east", "west") if len(word) > 2 and damerau(word, d, 1) <= 1), "")


def _connects(word: str) -> bool:
    return word in CONNECTORS or (len(word) <= 3 and any(damerau(word, c, 1) <= 1 for c in ("de", "du", "des", "la") if word[0] in c))


def _segment(text: str, at: int) -> str:
    end = text.find("|", at)
    return text[text.rfind("|", 0, at) + 1 : end if end >= 0 else len(text)]


def _has_street(segment: str) -> bool:
    words = re.findall(r"[^\W\d_]+", segment)
    return any(w in _TYPE_OF or _compound(w) for w in words)


def _near_type(word: str) -> str | None:
    """Type that a word is one slip away from; in short ones only swapped, doubled or lost letters."""
    short = {"str": "street", "crt": "court", "rue": "rue", "blvd": "boulevard", "drv": "drive"}
    for known, kind in short.items():
        if word != known and damerau(word, known, 1) <= 1 and set(word) <= set(known) and word[0] in known[:2]:
            if len(word) >= len(known) or word in ("sr", "tr", "bvd", "ru"):
                return kind
    if word in ("rct", "cct", "ctt"):
        return "court"
    if len(word) < 3:
        return None
    for known, kind in _TYPE_OF.items():
        if len(known) >= 4 and abs(len(known) - len(word)) <= 1 and damerau(word, known, 1) <= 1:
            return kind
    return None


def parse(address: str | None) -> tuple[str, str, str, str, str, str] | None:
    """(house number with letter, street type, direction, street name, town, postcode), or None.

    None for values that are no postal address: null, blank, links, mailboxes, coordinates, and
    texts without a house number or without a street.
    """
    if not address or not address.strip() or _NOT_POSTAL.search(address):
        return None
    text = re.sub(r"\s*(?:[,;\n\r\t|]+|\s[-–—/]+\s)\s*", " | ", " " + fold(address) + " ")
    code = ""
    if m := _UK.search(text):
        code = m[1] + m[2]
        text = text[: m.start()] + " ~ " + text[m.end() :]
    else:
        found = list(_ZIP.finditer(text))
        if len(found) > 1:  # a house number of five digits stands beside its street
            found = [m for m in found if not _has_street(_segment(text, m.start()))] or found[-1:]
        if found:
            m = found[0]
            code = m[1]
            text = text[: m.start()] + " ~ " + text[m.end() :]
    if m := _CARE.search(text):
        # an addressee is two words; what follows in its segment belongs to the address
        text = text[: m.start()] + " | " + re.sub(r"^[^\s|]+(?:\s+[^\s|]+)?", "", text[m.end() :])
    text = _UNIT.sub(" | ", text)
    for _ in range(2):
        text = _TRAILING_COUNTRY.sub(" ", text)
    text = _COUNTRY.sub(" ", text)
    text = re.sub(r"(?<![a-z])(?:no|nr|n)[.°o]* *(?=[0-9])", " ", text)
    text = re.sub(r"(?<=[a-z])['.]+(?=[a-z])", " ", text)
    tokens: list[tuple[str, int]] = []  # word, segment
    for k, part in enumerate(text.split("|")):
        tokens += [(w, k) for w in re.findall(r"[0-9]+[a-z]?(?![a-z0-9])|[^\W\d_]+|~", part)]
    numbers = [i for i, (w, _) in enumerate(tokens) if w[0].isdigit() and w[0].isdigit()]
    if not numbers:
        return None
    at = numbers[0]
    house, used = tokens[at][0].lstrip("0"), {at}
    if house.isdigit() and at + 1 < len(tokens):
        word, seg = tokens[at + 1]
        if len(word) == 1 and word.isalpha() and seg == tokens[at][1] and word not in "nsewlrd" or (word in ("d",) and seg == tokens[at][1]):
            house, used = house + word, used | {at + 1}
    words = [w for w, _ in tokens]
    free = [i for i in range(len(tokens)) if i not in used and words[i] != "~" and not words[i][0].isdigit()]
    street: tuple[str, str, list[int]] | None = None  # type, name, token places

    def ahead(start: int) -> list[int]:
        out = []
        for i in range(start, len(tokens)):
            if i in used:
                continue
            if words[i] == "~" or words[i][0].isdigit():
                break
            out.append(i)
        return out

    after = ahead(at + 1)
    # French: number, type, connector, name
    if after and after[0] <= max(used) + 1:
        i = after[0]
        kind = _TYPE_OF.get(words[i]) or (_near_type(words[i]) if len(after) > 1 and _connects(words[after[1]]) else None)
        follows = after[1:2] and _connects(words[after[1]])
        if kind in FRENCH and (follows or kind in ("rue", "chemin", "quai", "impasse")):
            span = [j for j in after if tokens[j][1] == tokens[i][1]]
            names = [j for j in span[1:] if not _connects(words[j])]
            others = [j for j in free if j not in span]
            if len(names) > 1 and not others and not code:
                names = names[:-1]
            place = [j for j in span if j <= (names[-1] if names else i)]
            street = (kind, "".join(words[j] for j in names), place)
    # English: number, name, type
    if street is None and after:
        exact = [j for j in after[1:5] if words[j] in _TYPE_OF and _TYPE_OF[words[j]] not in ("rue", "chemin")]
        same = [j for j in exact if tokens[j][1] == tokens[after[0]][1]]
        near = [j for j in after[1:4] if tokens[j][1] == tokens[after[0]][1] and _near_type(words[j])]
        own = _compound(words[after[0]])
        if same and not (own and not own[2]):
            j = same[0]
            place = [k for k in after if k <= j]
            street = (_TYPE_OF[words[j]], "".join(words[k] for k in place[:-1]), place)
        elif near and not own:
            j = near[0]
            place = [k for k in after if k <= j]
            street = (_near_type(words[j]), "".join(words[k] for k in place[:-1]), place)
    # German: a compound before or after the number, or a name and a type of their own
    if street is None:
        order = sorted(free, key=lambda j: (abs(j - at), j > at))
        for slips in (False, True):
            for j in order:
                made = _compound(words[j])
                if made and made[2] == slips:
                    street = (made[1], made[0], [j])
                    break
                kind = _TYPE_OF.get(words[j]) if not slips else _near_type(words[j])
                prior = [k for k in free if k < j and tokens[k][1] == tokens[j][1]]
                if kind and kind not in ("rue", "chemin") and prior:
                    street = (kind, words[prior[-1]], [prior[-1], j])
                    break
            if street:
                break
    if street is None or not street[1]:
        return None
    kind, name, place = street
    side = ""
    if kind not in ("rue", "chemin", "quai", "impasse") and len(place) > 2 and (turned := _direction(words[place[0]])):
        side, name = turned, "".join(words[j] for j in place[1:-1])
    rest = [j for j in free if j not in place and words[j] not in CONNECTORS and len(words[j]) > 2]
    if "~" in words and rest:  # the words next to the postcode, in its segment, name the town
        c = words.index("~")
        near = [j for j in rest if tokens[j][1] == tokens[c][1]]
        rest = near or rest
    if len({tokens[j][1] for j in rest}) > 1:  # several segments are left: the town follows the street, or else comes first
        last = max(tokens[j][1] for j in place)
        later = [tokens[j][1] for j in rest if tokens[j][1] >= last]
        segment = min(later) if later else min(tokens[j][1] for j in rest)
        rest = [j for j in rest if tokens[j][1] == segment]
    town = "".join(words[j] for j in rest)
    if not town and not code:
        return None
    return house, kind, side, _plain(name), _plain(town), code


def parsed_addresses(records: DataFrame) -> DataFrame:
    """``records`` (key, address) with the parts of each postal address; other values are left out.

    Every distinct writing is parsed once.
    """
    schema = "address string, " + ", ".join(f"{f} string" for f in FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(a, *p) for a in batch["address"] if (p := parse(a))]
            yield pd.DataFrame(got, columns=["address", *FIELDS])

    written = spread(records.where("address is not null").select("address"), "address").distinct()
    return records.join(written.mapInPandas(run, schema), "address")


def with_towns(parts: DataFrame) -> DataFrame:
    """Parts with the town known by its postcode where it is left out or spelt otherwise."""
    counted = parts.where("code <> '' and town <> ''").groupBy("code", "town").count()
    best = counted.groupBy("code").agg(F.max_by("town", F.struct("count", "town")).alias("known"))
    joined = parts.join(best, "code", "left")
    return joined.withColumn("town", F.coalesce("known", F.when(F.col("town") == "", F.col("code")).otherwise(F.col("town")))).drop("known")


def ngram_links(forms: DataFrame, cosine: float = 0.55, size: int = 3) -> DataFrame:
    """Pairs (a, b) of forms with equal house number whose weighted n-grams reach ``cosine``.

    ``forms``: form, house, shown; ``house`` may be an array of keys, of which two forms need one in
    common. Weights are inverse document frequencies. With n-grams ordered
    by falling weight, two vectors can only reach the threshold if they share an n-gram among those
    that come before the rest falls below it, so only these are indexed, and nothing is lost.
    """
    grams = forms.select("form", "house", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(shown) - {size - 1}), i -> substring(shown, i, {size}))"))).alias("gram"))
    uses = grams.groupBy("gram").agg(F.count("*").alias("df"))
    weights = uses.select("gram", F.log(1 + F.lit(forms.count()) / F.col("df")).alias("w"))
    vector = F.sort_array(F.collect_list(F.struct("w", "gram")), asc=False)
    vectors = grams.join(weights, "gram").groupBy("form", "house").agg(vector.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    vectors = vectors.withColumn("norm", norm)
    # prefix: the shortest head after which the tail's norm is below cosine * norm
    tails = F.aggregate(
        "v",
        F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            (s["seen"] + x["w"] * x["w"]).alias("seen"),
            (s["n"] + F.when(F.col("norm") * F.col("norm") - s["seen"] >= cosine * cosine * F.col("norm") * F.col("norm"), 1).otherwise(0)).alias("n"),
        ),
    )
    vectors = vectors.withColumn("prefix", tails["n"])
    index = vectors.select("house", "form", F.explode(F.expr("slice(v, 1, prefix)")).alias("x")).select("house", "form", F.col("x.gram").alias("gram"))
    if isinstance(forms.schema["house"].dataType, ArrayType):
        index = index.withColumn("house", F.explode("house"))
    other = index.withColumnRenamed("form", "form_b")
    pairs = index.withColumnRenamed("form", "form_a").join(other, ["house", "gram"]).where("form_a < form_b").select("form_a", "form_b").distinct()
    left = vectors.select(F.col("form").alias("form_a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = vectors.select(F.col("form").alias("form_b"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["gram"], x["w"]))).alias("vb"), F.col("norm").alias("nb"))
    full = pairs.join(left, "form_a").join(right, "form_b")
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at("vb", x["gram"]), F.lit(0.0)) * x["w"])
    return full.withColumn("cosine", dot / (F.col("na") * F.col("nb"))).where(F.col("cosine") >= cosine).select(F.col("form_a").alias("a"), F.col("form_b").alias("b"), "cosine")


def place_classes(records: DataFrame) -> DataFrame:
    """Class of each record (key, address) that holds a postal address: (key, place).

    Two records get one place if house number with letter, street and town agree, up to spelling
    slips, abbreviations and order. Null keys, null and non-postal values are left out.
    """
    parts = with_towns(cut(parsed_addresses(records)))
    for column in ("town", "street"):
        parts = canonical_words(parts, column)
    parts = parts.withColumn("shown", F.concat(F.lit(" "), F.concat_ws(" ", "side", "street", "kind"), F.lit(" "), F.col("town"), F.lit(" ")))
    parts = parts.withColumn("form", F.xxhash64("house", "shown"))
    parts = cut(parts.select("key", "form", "house", "kind", "side", "street", "town", "shown", "code"))
    forms = parts.groupBy("form").agg(*[F.first(c).alias(c) for c in ("house", "kind", "side", "street", "town", "shown")], F.collect_set(F.when(F.col("code") != "", F.col("code"))).alias("codes"))
    for column in ("street", "town"):
        usage = parts.groupBy(column).agg(F.count("*").alias(f"{column}_n"))
        forms = forms.join(usage, column)
    forms = cut(forms)
    # what must be equal or near anyway belongs to the index keys, so that few forms meet: a town's
    # keys are its own name and the names in use that are one slip away
    towns = forms.where(f"length(town) >= {LEAST_SLIP} and not town rlike '[0-9]'").groupBy(F.col("town").alias("word")).agg(F.count("*").alias("n"))
    near = near_words(towns).groupBy(F.col("word").alias("town")).agg(F.collect_list("usual").alias("near"))
    keyed = forms.join(near, "town", "left")
    own = F.concat(F.array("town"), F.coalesce("near", F.array().cast("array<string>")))
    links = ngram_links(keyed.select("form", F.transform(own, lambda t: F.concat_ws("|", "house", "kind", "side", t)).alias("house"), "shown"))
    facts = forms.drop("house", "shown")
    a = facts.select([F.col(c).alias(f"{c}_a") for c in facts.columns])
    b = facts.select([F.col(c).alias(f"{c}_b") for c in facts.columns])
    both = links.join(a, F.col("a") == F.col("form_a")).join(b, F.col("b") == F.col("form_b"))
    close = both.where("kind_a = kind_b and side_a = side_b").where(_near("street", F.arrays_overlap("codes_a", "codes_b")) & _near("town", F.lit(False)))
    place = connected_components(forms.select(F.col("form").alias("node")), close.select("a", "b"))
    return parts.select("key", "form").join(place.withColumnRenamed("node", "form"), "form").select("key", F.col("component").alias("place"))


#: Letters from which on a word may have a slip.
LEAST_SLIP = 5


def _near(column: str, sure: Column, ratio: float = 3.0) -> Column:
    """Equal, or one slip apart in words of ``LEAST_SLIP`` letters or more, of which one is far more usual unless the rest is ``sure``."""
    a, b, n, m = (F.col(f"{column}{x}") for x in ("_a", "_b", "_n_a", "_n_b"))
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.sort_array(F.split(a, "")) == F.sort_array(F.split(b, "")))
    slip = ((F.levenshtein(a, b) <= 1) | swap) & (F.coalesce(sure, F.lit(False)) | (F.greatest(n, m) >= ratio * F.least(n, m)))
    digits = a.rlike("[0-9]") | b.rlike("[0-9]")
    return (a == b) | (~digits & (F.least(F.length(a), F.length(b)) >= LEAST_SLIP) & slip)


def member_pairs(members: DataFrame, class_column: str, key: str = "key", block: int = 2000) -> DataFrame:
    """All pairs of members of a class as (left_key, right_key), the smaller string first.

    A class of more than ``block`` members is split: each member meets the class block by block,
    so that no task holds a whole class.
    """
    sizes = members.groupBy(class_column).agg(F.count("*").alias("n")).where("n > 1")
    sized = members.join(sizes, class_column).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    left = sized.select(class_column, F.col(key).alias("left_key"), F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("part"))
    right = sized.select(class_column, F.col(key).alias("right_key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    return left.join(right, [class_column, "part"]).where("left_key < right_key").select("left_key", "right_key")

