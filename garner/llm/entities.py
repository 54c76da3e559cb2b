"""Records of different tables that are one person.

Candidates come from MinHash blocking over several attributes: numbers, mailboxes, account names,
and, together with MinHash bands of the name, partial numbers and surroundings. Features of each
pair go through a logistic classifier trained on weak labels and calibrated on held-out pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garner.llm.addresses import fold, member_pairs
from garner.operators.components import connected_components
from garner.session import cut, spread

BANDS, ROWS = 12, 2
#: A block of more records is split by the names of its members: ``name_keys`` and name bands.
BLOCK_SIZE = 20
#: A number, mailbox or account name is many people's if its records are more than so many times those of its commonest name.
WIDE = 4
#: Pairs drawn for training at most, in the order of their hash.
TRAINING_PAIRS = 30_000
#: Records at most whose namesakes are training pairs beside those, in the order of their names' hash.
TRAINING_NAMES = 10_000
DECIDE = 0.5

# Country calling codes of one and two digits; all others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words of company names that don't tell companies apart, and words around them.
_COMMON = set(
    "partners logistics analytics studio bakery clinic foods publishing robotics working living works work was met at busy available through lives based moved in to the crew only calls i my a inc ltd gmbh llc co company group and of from new on battery".split()
)
_TITLES = r"\b(?:dr|prof|mr|mrs|ms|mme|mlle|herr|frau|sr|sra)\b\.?"


def national_number(value: str | None) -> tuple[str, str] | None:
    """(country code or '', number without trunk zero) of a phone number written in any way; None if it is none."""
    if not value or "@" in value or "•" in value or "*" in value:
        return None
    digits = re.sub(r"[^\d+]", "", re.sub(r"\(0\)", "", value))
    if digits.startswith("00"):
        digits = "+" + digits[2:]
    if digits.startswith("+"):
        rest = digits[1:].replace("+", "")
        n = 1 if rest[:1] in _ONE_DIGIT else 2 if rest[:2] in _TWO_DIGITS else 3
        code, number = rest[:n], rest[n:].lstrip("0")
    elif len(digits) == 11 and digits[0] == "1":
        code, number = "1", digits[1:]
    else:
        code, number = "", digits.lstrip("0")
    return (code, number) if 7 <= len(number) <= 12 else None


def mailbox(value: str | None) -> str | None:
    """Mailbox in one form: lower case, without scheme and plus tag."""
    if not value or value.count("@") != 1:
        return None
    local, domain = re.sub(r"^mailto:", "", value.strip().lower()).split("@")
    local = local.split("+")[0]
    return f"{local}@{domain}" if local and "." in domain else None


def name_parts(name: str | None, sort_name: str | None = None) -> tuple[str, str, bool]:
    """(first, last, sure of the order) in folded form, '' where unknown.

    Reads 'Last, First', titles, notes behind a dash and sort names, which put the last name first.
    """
    if not name or not name.strip():
        return "", "", True
    sure = "," in name
    text = re.sub(r"\s+[-–(].*$", "", fold(name).replace("ø", "o").replace("ł", "l"))
    text = re.sub(r"(?<=[a-z])ae|(?<=[a-z])oe|(?<=[a-z])ue", lambda m: m[0][0], re.sub(_TITLES, " ", text))
    if "," in text:
        last, _, first = text.partition(",")
        if not first.strip(" ."):
            return "", (re.findall(r"[a-z][a-z']*", last) or [""])[-1], True
        text = f"{first} {last}"
    words = re.findall(r"[a-z][a-z']*\.?", text)
    words = [w for i, w in enumerate(words) if not (w.endswith(".") and 0 < i < len(words) - 1)]
    if not words:
        return "", "", True
    first, last = words[0], words[-1] if len(words) > 1 else ""
    known = name_parts(sort_name)[1::-1] if sort_name and sort_name.strip() else ("", "")
    if known[0] and known[1]:
        if len(last.strip(".")) <= 1 and known[1].startswith(last.strip(".")):
            last = known[1]
        if len(first.strip(".")) <= 1 and known[0].startswith(first.strip(".")):
            first = known[0]
        if (first, last) == (known[1], known[0]):
            first, last = last, first
        sure = True
    return first.strip("."), last.strip("."), sure


def surroundings(*texts: str | None) -> list[str]:
    """Names of places and firms in remarks, without common words."""
    words = [w for t in texts if t for w in re.findall(r"[^\W\d_]{3,}", t) if w[0].isupper()]
    return sorted({fold(w) for w in words} - _COMMON)


def name_bands(first: str, last: str) -> list[int]:
    """Band hashes of the MinHash of the name's letter pairs; none without a last name."""
    if not last:
        return []
    shown = f"^{first[:1]}|{last}$"
    grams = {shown[i : i + 2] for i in range(len(shown) - 1)}
    mins = [min(xxhash.xxh64_intdigest(g, seed=s) for g in grams) for s in range(BANDS * ROWS)]
    return [xxhash.xxh32_intdigest(repr(mins[b * ROWS : (b + 1) * ROWS]), seed=b) for b in range(BANDS)]


def _slips(word: str, places: int) -> set[str]:
    """The word and the word without one of its first letters; words one slip apart there have one in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(min(places, len(word)))} if len(word) >= 4 else {word}


def name_keys(first: str, last: str, aka=()) -> tuple[list[int], list[int]]:
    """(keys as the left of a pair, keys as the right); records whose names can be one person's have one in common.

    Complete for the features of names: two records whose names contradict each other in neither part
    always meet, also without a last name. Many keys have two roles, such as short form and
    full one, of which only different ones meet. A record without any name has no keys.
    """
    if not first and not last:
        return [], []
    both = {f"P{first[:2]}"} if len(first) > 1 else {f"S{first}"} if first else set()
    short, full = {f"A{x}" for x in aka}, {f"A{first}", *(f"T{first[i : i + 3]}" for i in range(1, len(first) - 2))}
    (short if len(first) == 1 else full).add(f"I{first[:1]}")
    if len(first) >= 4:  # slips within the first two letters; from the third letter on, P meets
        both |= {f"D{w}" for w in _slips(first, 3)}
        short.add(f"T{first[:3]}")
    firsts = [(k, k) for k in both] + [(f"{k}<", f"{k}>") for k in short] + [(f"{k}>", f"{k}<") for k in full]
    if not last:
        lasts = [("-", "+"), ("--", "--")]
    else:
        lasts = [("+", "-"), (f"{last[0]}<", f"{last[0]}>") if len(last) == 1 else (f"{last[0]}>", f"{last[0]}<")]
    pairs = [(f"{x}|{y}", f"{v}|{w}") for x, v in firsts for y, w in lasts] if first else []
    pairs += [(f"L{w}", f"L{w}") for w in (_slips(last, len(last)) if last else ())]
    code = lambda text: xxhash.xxh64_intdigest(text) - (1 << 63)
    return sorted({code(a) for a, _ in pairs}), sorted({code(b) for _, b in pairs})


RAW = "rec string, side string, first string, last string, aka array<string>, phones array<string>, mails array<string>, locals array<string>, tails array<string>, masked boolean, around array<string>, sure boolean"
#: What matching works on: the raw profile with the name set straight.
PROFILE = RAW.replace("sure boolean", "usual long, left_keys array<long>, right_keys array<long>")


def profile(rec: str, side: str, name: str | None, sort_name: str | None = None, aka=(), phones=(), mails=(), accounts=(), remarks=()) -> tuple:
    """One record's attributes in comparable form, as a row of ``RAW``."""
    first, last, sure = name_parts(name, sort_name)
    numbers = [n for p in phones if (n := national_number(p))]
    boxes = sorted({m for v in mails if (m := mailbox(v))})
    masked = [p for p in phones if p and re.search(r"[•*]", p)]
    tails = {n[1][-4:] for n in numbers} | {d[-4:] for p in masked if len(d := re.sub(r"\D", "", re.split(r"[•*]", p)[-1])) >= 4}
    own = {b.split("@")[0] for b in boxes} | {a.lower().lstrip("@") for a in accounts if a}
    locals_ = sorted({re.sub(r"[._\-]", "", x) for x in own if len(x) >= 4})
    return (
        rec, side, first, last, sorted({name_parts(a)[0] for a in aka if a} - {""}), sorted({n[1] for n in numbers}), boxes, locals_,
        sorted(tails), bool(masked), surroundings(*remarks), sure,
    )


def json_strings(value: str | None) -> list[str]:
    """All strings in a JSON text; none if it can't be read."""
    try:
        found = json.loads(value) if value else []
    except ValueError:
        return []
    flat = found.values() if isinstance(found, dict) else [found]
    return [x for part in flat for x in (part if isinstance(part, list) else [part]) if isinstance(x, str)]


def profiles(rows: DataFrame, side: str, read) -> DataFrame:
    """``RAW`` rows; ``read`` takes a row as a dict and gives the arguments of ``profile`` behind ``side``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RAW.split(", ")]
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                args = read(r)
                out.append(profile(args.pop("rec"), side, **args))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, RAW)


def straighten(raw: DataFrame) -> DataFrame:
    """``RAW`` rows as ``PROFILE`` rows: names in reverse order turned, with the use of the first name and the name's keys.

    Two words of unsure order are turned when the second stands first in other names far more
    often; a word alone, or beside an initial, is a last name when other names have it as such far
    more often. ``usual`` counts the records with that first name.
    """
    raw = cut(spread(raw, "rec"))
    words = F.array(F.struct(F.col("first").alias("word"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("last").alias("word"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    use = raw.where("last <> ''").select(F.explode(words).alias("w")).where("length(w.word) > 1").groupBy("w.word").agg(F.sum("w.x").alias("leads"), F.sum("w.y").alias("ends"))
    called = raw.where("length(first) > 1").groupBy("first").agg(F.count("*").alias("n_first"))
    joined = raw.join(called, "first", "left").join(use.select(F.col("word").alias("first"), F.col("leads").alias("leads_first"), F.col("ends").alias("ends_first")), "first", "left")
    joined = joined.join(called.select(F.col("first").alias("last"), F.col("n_first").alias("n_last")), "last", "left")
    counts = ("n_first", "n_last", "leads_first", "ends_first")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    columns = [c.split()[0] for c in PROFILE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n, m = int(r["n_first"]), int(r["n_last"])
                if not r["sure"] and len(r["first"]) > 1 and len(r["last"]) > 1 and m > 3 * n:
                    r["first"], r["last"], n = r["last"], r["first"], m
                elif len(r["first"]) > 1 and len(r["last"]) <= 1 and r["ends_first"] > 3 * r["leads_first"]:
                    r["first"], r["last"], n = r["last"], r["first"], 0
                bands = name_bands(r["first"], r["last"])
                left, right = name_keys(r["first"], r["last"], [] if r["aka"] is None else r["aka"])
                out.append([r.get(c) for c in columns[:-3]] + [n, bands + left, bands + right])
            yield pd.DataFrame(out, columns=columns)

    return cut(joined.mapInPandas(run, PROFILE))


def told_apart(records: DataFrame, lead: str = "people") -> DataFrame:
    """``PROFILE`` rows with ``same``, the smallest record of the side that says the same, and ``times``, how many say so.

    Records of a side that say the same, a number or mailbox among it, are one record written
    several times: they are matched once (``rec = same``), and the others go with it. On the
    ``lead`` side they bear a name, too.
    """
    said = F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != "rec"])), 256)
    telling = (F.size("phones") + F.size("mails") > 0) & ((F.col("side") != lead) | (F.concat("first", "last") != ""))
    keyed = records.withColumn("said", F.when(telling, said).otherwise(F.col("rec")))
    often = keyed.groupBy("said").agg(F.min("rec").alias("same"), F.count("*").alias("times")).where("times > 1")
    return keyed.join(often, "said", "left").select(*records.columns, F.coalesce("same", "rec").alias("same"), F.coalesce("times", F.lit(1)).alias("times"))


def candidate_pairs(records: DataFrame) -> DataFrame:
    """Pairs (a, b) of records of different sides with the smallest spread of a block of each kind.

    The spread of a number, mailbox or account name is the number of its records as a multiple of
    those with its commonest name (initial and last name). It doesn't grow with an archive in which
    namesakes share the account names that are made of their names.

    Blocks of more than ``BLOCK_SIZE`` records are split by the members' name keys and bands, and so
    are all of partial numbers and surroundings: whatever the size, pairs meet whose names can be one
    person's, and in blocks of narrow spread also records without any name. What doesn't meet there has names that contradict each other,
    or no name at all where nothing tells whose number it is. Account names also meet those that are the same but for
    digits added behind. A record that stands for several (``times``, see ``told_apart``) counts as many.
    """
    records = records if "times" in records.columns else records.withColumn("times", F.lit(1))
    # digits behind an account name: without one, two, ... of them it meets the account names that are written so
    grown = F.expr("flatten(transform(locals, x -> transform(sequence(0, length(regexp_extract(x, '[0-9]*$', 0))), n -> substring(x, 1, length(x) - n))))")
    shorter = F.array_distinct(F.expr("filter(__grown, x -> length(x) >= 4 and not array_contains(locals, x))"))
    records = records.withColumn("__grown", grown).withColumn("__grown", shorter)
    # (kind, tokens, whether the record is the left of a pair, and the right)
    plain = [("phone", "phones", True, True), ("mail", "mails", True, True), ("local", "locals", True, True), ("grown<", "locals", True, False), ("grown<", "__grown", False, True), ("grown>", "__grown", True, False), ("grown>", "locals", False, True)]
    keys = None
    for kind, column, as_left, as_right in plain:
        part = records.select("rec", "side", "first", "last", "times", "left_keys", "right_keys", F.lit(kind).alias("kind"), F.explode(column).alias("token"), F.lit(as_left).alias("as_left"), F.lit(as_right).alias("as_right"))
        keys = part if keys is None else keys.unionByName(part)
    initial = F.when(F.col("first") != "", F.substring("first", 1, 1))
    called = F.when(F.col("last") != "", F.concat(initial, F.lit(" "), "last")).otherwise(F.col("first"))
    once = keys.select("kind", "token", called.alias("called"), "rec", "times", initial.alias("initial")).distinct()
    names = once.groupBy("kind", "token", "called").agg(F.sum("times").alias("n"), F.min("initial").alias("low"), F.max("initial").alias("high"))
    lead = F.greatest(F.max(F.when(F.col("called") != "", F.col("n"))), F.lit(1))
    sizes = names.groupBy("kind", "token").agg(F.sum("n").alias("df"), (F.sum("n") / lead).alias("spread"), (F.min("low") != F.max("high")).alias("contested")).where("df > 1")
    sized = keys.join(sizes, ["kind", "token"]).withColumn("contested", F.coalesce("contested", F.lit(False)))
    whole = F.array(F.lit(0).cast("long"))
    # small numbers, which no hash of a name is: records without a name meet all, those with one only them
    nameless, narrow = F.expr("first = '' and last = ''"), (F.col("spread") <= WIDE) & ~F.col("contested")
    roles = lambda *n: F.array(*[F.lit(x).cast("long") for x in n])
    met_nameless = {"left_keys": (roles(1, 2), roles(3)), "right_keys": (roles(1, 3), roles(2))}
    split = lambda c: F.when(F.col("df") <= BLOCK_SIZE, whole).when(~narrow, F.col(c)).when(nameless, met_nameless[c][0]).otherwise(F.concat(c, met_nameless[c][1])).alias(c)
    blocks = sized.select("kind", "token", "rec", "side", "spread", "contested", split("left_keys"), split("right_keys"), "as_left", "as_right")
    around = F.expr("flatten(transform(around, (x, i) -> transform(slice(around, i + 2, size(around)), y -> concat(x, '|', y))))")
    loose = None
    for kind, tokens in (("tail", F.col("tails")), ("around", around)):
        part = records.select("rec", "side", F.lit(kind).alias("kind"), F.explode(tokens).alias("token"), "left_keys", "right_keys")
        loose = part if loose is None else loose.unionByName(part)
    met_by = loose.groupBy("kind", "token").agg((F.min("side") != F.max("side")).alias("met")).where("met").drop("met")
    loose = loose.join(met_by, ["kind", "token"])
    blocks = blocks.unionByName(loose.select("kind", "token", "rec", "side", F.lit(1.0).alias("spread"), F.lit(False).alias("contested"), "left_keys", "right_keys", F.lit(True).alias("as_left"), F.lit(True).alias("as_right")))
    left = blocks.where("as_left").select("kind", "token", F.col("rec").alias("a"), "side", "spread", "contested", F.explode("left_keys").alias("name_key"))
    right = blocks.where("as_right").select("kind", "token", F.col("rec").alias("b"), F.col("side").alias("side_b"), F.explode("right_keys").alias("name_key"))
    met = left.join(right, ["kind", "token", "name_key"]).where("side < side_b")
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("spread"))).alias(kind)
    return met.groupBy("a", "b").agg(pick("phone"), pick("mail"), pick("local"), F.min(F.when(F.col("kind").isin("phone", "mail"), F.col("contested").cast("int"))).alias("contested"))


FEATURES = (
    "phone", "phone_wide", "mail", "mail_wide", "local_digits", "local", "local_wide", "local_grown", "tail", "tail_not", "phone_not", "mail_not", "around_2", "around_1", "around_0", "contested",
    "last", "last_near", "last_not", "last_gone", "first", "first_near", "first_not", "first_gone", "nameless_contested",
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def _one_slip(a: str, b: str) -> str:
    """SQL: two words are one insertion, deletion, substitution or swap of neighbours apart, or equal."""
    swap = f"exists(sequence(1, length({a}) - 1), i -> concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})"
    return f"(levenshtein({a}, {b}, 1) >= 0 or (length({a}) = length({b}) and length({a}) > 1 and {swap}))"


def feature_columns() -> dict[str, Column]:
    """``FEATURES`` of a row that holds two profiles, columns ending in _a and _b, as expressions.

    Two usual first names are different however near they are, one rarely used beside a usual one
    is a slip or a short form of it.
    """
    meet = lambda c: f"arrays_overlap({c}_a, {c}_b)"
    apart = lambda c: f"(size({c}_a) > 0 and size({c}_b) > 0 and not {meet(c)})"
    masked = "(masked_a or masked_b)"
    shared = "array_intersect(locals_a, locals_b)"
    digits = f"exists({shared}, x -> x rlike '[0-9]')"
    grown = "exists(locals_{0}, x -> exists(locals_{1}, y -> length(y) > length(x) and substring(y, 1, length(x)) = x and substring(y, length(x) + 1) rlike '^[0-9]+$'))"
    n_around = "size(array_intersect(around_a, around_b))"
    known_around = "(size(around_a) > 0 and size(around_b) > 0)"
    last_short = "if(length(last_a) <= length(last_b), last_a, last_b)"
    last_long = "if(length(last_a) <= length(last_b), last_b, last_a)"
    last_gone = "(last_a = '' or last_b = '')"
    last_near = f"(not {last_gone} and last_a <> last_b and if(least(length(last_a), length(last_b)) = 1, startswith({last_long}, {last_short}), least(length(last_a), length(last_b)) >= 4 and {_one_slip('last_a', 'last_b')}))"
    short = "if(length(first_a) <= length(first_b), first_a, first_b)"
    long = "if(length(first_a) <= length(first_b), first_b, first_a)"
    n_short, n_long = "least(length(first_a), length(first_b))", "greatest(length(first_a), length(first_b))"
    first_gone = "(first_a = '' or first_b = '')"
    called = f"(array_contains(aka_b, first_a) or array_contains(aka_a, first_b) or ({n_short} = 1 and startswith({long}, {short})))"
    same_start = lambda n: f"({n_short} >= {n} and substring(first_a, 1, {n}) = substring(first_b, 1, {n}))"
    alike = (
        f"(startswith({long}, {short}) or ({n_short} >= 4 and {_one_slip('first_a', 'first_b')}) or ({same_start(3)} and {n_short} <= 5) or ({same_start(2)} and {n_short} <= 4)"
        f" or ({n_short} >= 4 and contains({long}, substring({short}, 1, {n_short} - 1))))"
    )
    usual = "(least(usual_a, usual_b) > 0.25 * greatest(usual_a, usual_b))"
    first_near = f"(not {first_gone} and first_a <> first_b and ({called} or (not {usual} and {alike})))"
    tests = {
        "phone": f"phone <= {WIDE}", "phone_wide": f"phone > {WIDE}", "mail": f"mail <= {WIDE}", "mail_wide": f"mail > {WIDE}",
        "local_digits": digits, "local": f"size({shared}) > 0 and not {digits} and local <= {WIDE}", "local_wide": f"size({shared}) > 0 and not {digits} and coalesce(local > {WIDE}, true)",
        "local_grown": f"size({shared}) = 0 and ({grown.format('a', 'b')} or {grown.format('b', 'a')})",
        "tail": f"{masked} and {meet('tails')}", "tail_not": f"{masked} and {apart('tails')}", "phone_not": f"not {masked} and {apart('phones')}", "mail_not": apart("mails"),
        "around_2": f"{known_around} and {n_around} >= 2", "around_1": f"{known_around} and {n_around} = 1", "around_0": f"{known_around} and {n_around} = 0", "contested": "contested = 1",
        "last": f"not {last_gone} and last_a = last_b", "last_near": last_near, "last_not": f"not {last_gone} and last_a <> last_b and not {last_near}", "last_gone": last_gone,
        "first": f"not {first_gone} and first_a = first_b", "first_near": first_near, "first_not": f"not {first_gone} and first_a <> first_b and not {first_near}", "first_gone": first_gone,
        "nameless_contested": f"contested = 1 and {first_gone} and {last_gone}",
    }
    return {name: F.coalesce(F.expr(test), F.lit(False)).cast("double") for name, test in tests.items()}


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, x, kept): the feature vector of every candidate pair, and whether a mailbox's account name is written alike in both.

    Written alike are account names that are the same with their dots and dashes, but for digits
    added behind. That is no feature, as archives differ in how they write them; it tells leads apart
    that are as likely otherwise.
    """
    use = ["rec", "first", "last", "aka", "phones", "mails", "locals", "tails", "masked", "around", "usual"]
    side = lambda s: records.select([F.col(c).alias(s if c == "rec" else f"{c}_{s}") for c in use])
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    columns = feature_columns()
    written = lambda s: f"transform(mails_{s}, m -> substring_index(m, '@', 1))"
    behind = "(startswith({0}, {1}) and substring({0}, length({1}) + 1) rlike '^[0-9]*$')"
    kept = F.expr(f"exists({written('a')}, v -> exists({written('b')}, w -> {behind.format('v', 'w')} or {behind.format('w', 'v')}))").cast("int")
    return full.select("a", "b", F.array(*[columns[f] for f in FEATURES]).alias("x"), kept.alias("kept"))


def weak_labels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training rows, labels and row numbers from feature rows, by rules of thumb.

    Positive: a number, mailbox or account name few records have, the end of a masked number or two
    surroundings in common, with equal names. Negative: names
    that contradict each other, and equal names with nothing else in common. Copies without the
    attributes that gave the label, or without names, teach the classifier the weight of what is left.
    """
    f = lambda n: x[:, _AT[n]] > 0
    strong = f("phone") | f("mail") | f("local_digits") | f("local") | f("local_grown")
    support = f("local_digits") | f("local") | f("local_grown") | f("tail") | f("around_2")
    alike = (f("last") | f("last_near")) & (f("first") | f("first_near")) & (f("last") | f("first"))
    good = alike & (strong | support)
    bad = f("first_not") | f("last_not") | ~(strong | support | f("phone_wide") | f("mail_wide") | f("local_wide"))
    names = [_AT[n] for n in FEATURES if n.startswith(("last", "first"))]
    shared = [_AT[n] for n in ("phone", "phone_wide", "mail", "mail_wide")]
    rows, labels, origin = [], [], []

    def add(at: np.ndarray, copies: np.ndarray, label: int) -> None:
        rows.append(copies)
        labels.append(np.full(len(at), label))
        origin.append(at)

    for mask, label in ((good, 1), (bad & ~good, 0)):
        at = np.flatnonzero(mask)
        add(at, x[at], label)
        held = at[strong[at]]
        nameless = x[held].copy()
        nameless[:, names] = 0
        nameless[:, [_AT["last_gone"], _AT["first_gone"]]] = 1
        nameless[:, _AT["nameless_contested"]] = nameless[:, _AT["contested"]]
        add(held, nameless, label)
        kept = at[support[at] & strong[at]]
        unshared = x[kept].copy()
        unshared[:, shared] = 0
        add(kept, unshared, label)
    return np.vstack(rows), np.concatenate(labels), np.concatenate(origin)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(sample: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights, and scale and shift of the scores that calibrate them on a held-out fifth of the pairs."""
    x, y, origin = weak_labels(sample) if len(sample) else (np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, int))
    if len(set(y.tolist())) < 2:
        w = np.zeros(len(FEATURES) + 1)
        for name, weight in (("phone", 4), ("mail", 4), ("local_digits", 3), ("tail", 2), ("around_2", 3), ("first_not", -8), ("last_not", -8)):
            w[_AT[name]] = weight
        w[-1] = -2
        return w, (1.0, 0.0)
    held = origin % 5 == 0
    w = _fit(x[~held], y[~held]) if len(set(y[~held].tolist())) == 2 else _fit(x, y)
    z = x[held] @ w[:-1] + w[-1]
    if len(set(y[held].tolist())) < 2:
        return w, (1.0, 0.0)
    scale, shift = _fit(z[:, None], y[held].astype(float), penalty=1e-2)
    return w, (float(scale), float(shift))


def namesakes(records: DataFrame) -> DataFrame:
    """(a, b) of records of different sides that follow one another among those of one name.

    For training only: of records with both names, the ``TRAINING_NAMES`` whose names have the
    smallest hashes. Most of the pairs are different people.
    """
    named = records.where("length(first) > 1 and length(last) > 1").select("rec", "side", "first", "last")
    drawn = named.orderBy(F.xxhash64("first", "last"), "rec").limit(TRAINING_NAMES)
    order = Window.partitionBy("first", "last").orderBy(F.xxhash64("rec"), "rec")
    both = drawn.withColumn("next", F.lead(F.struct("rec", "side")).over(order)).where("next.side <> side")
    return both.select(F.expr("if(side < next.side, rec, next.rec)").alias("a"), F.expr("if(side < next.side, next.rec, rec)").alias("b"))


def matched_pairs(records: DataFrame) -> DataFrame:
    """(a, b, confidence, kept) of candidate pairs that are likely one person: the classifier alone decides.

    ``records``: rows of ``PROFILE``, one per record.
    """
    features = cut(pair_features(candidate_pairs(records), records))
    drawn = features.orderBy(F.xxhash64("a", "b")).limit(TRAINING_PAIRS).select("a", "b", "x").toPandas()
    nothing = {c: F.lit(None).cast("double") for c in ("phone", "mail", "local")} | {"contested": F.lit(None).cast("int")}
    apart = namesakes(records).withColumns(nothing).join(features.select("a", "b"), ["a", "b"], "left_anti")
    others = pair_features(apart, records).toPandas()["x"]
    rows = [*drawn["x"], *others]
    weights, (scale, shift) = train(np.array([list(r) for r in rows]) if rows else np.zeros((0, len(FEATURES))))
    terms = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        terms = terms + F.col("x")[i] * F.lit(float(w))
    scored = features.withColumn("confidence", 1 / (1 + F.exp(-(terms * F.lit(scale) + F.lit(shift)))))
    return scored.where(F.col("confidence") >= DECIDE).select("a", "b", "confidence", "kept")


def one_person_each(matches: DataFrame, lead: str = "people") -> DataFrame:
    """``matches`` without those that would make two records of the ``lead`` side one person.

    The lead side holds one record per person, so namesakes there are different people. Every
    other record keeps its most confident lead record; a pair of other records stays if both keep
    the same one or neither has one, and a record without one follows its most confident partner.

    Of lead records that are as likely, those come first whose mailbox writes the account name alike
    (``kept``), then those that fewest other records of the side belong to beyond doubt: namesakes
    whose account names are made of their names have one record each more often than two.
    """
    led = F.substring_index("b", ":", 1) == lead  # sides are in the order of their names, the lead's last
    owned = cut(matches.withColumn("led", led))
    place = F.struct("confidence", F.col("kept") if "kept" in matches.columns else F.lit(0).alias("kept"))
    ranked = owned.where("led").select("a", "b", F.substring_index("a", ":", 1).alias("side"), place.alias("place"))
    first = cut(ranked.join(ranked.groupBy("a").agg(F.max("place").alias("top")), "a").where("place = top").select("a", "b", "side"))
    taken = first.groupBy("a", "side").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").groupBy("b", "side").agg(F.count("*").alias("taken"))
    best = first.join(taken, ["b", "side"], "left").groupBy("a").agg(F.max_by("b", F.struct(-F.coalesce("taken", F.lit(0)), "b")).alias("owner"))
    firm = owned.where("led").join(best, "a").where("b = owner").select("a", "b", "confidence")
    rest = owned.where("not led")
    for side in ("a", "b"):
        rest = rest.join(best.select(F.col("a").alias(side), F.col("owner").alias(f"owner_{side}")), side, "left")
    rest = cut(rest)
    for side, other in (("a", "b"), ("b", "a")):
        led_by = rest.where(f"owner_{side} is null and owner_{other} is not null").groupBy(side).agg(F.max_by(f"owner_{other}", F.struct("confidence", f"owner_{other}")).alias(f"via_{side}"))
        rest = rest.join(led_by, side, "left")
    a, b = F.coalesce("owner_a", "via_a"), F.coalesce("owner_b", "via_b")
    return firm.unionByName(rest.where(a.eqNullSafe(b)).select("a", "b", "confidence"))


def person_classes(matches: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """(key, person): the component of ``matches`` each matched record is in.

    ``repeats``: rec, same; every record that says the same as a matched one is in its component.
    """
    linked = matches.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    classes = connected_components(linked, matches.select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("person"))
    return classes if repeats is None else classes.join(repeats, F.col("key") == F.col("same")).select(F.col("rec").alias("key"), "person")


def same_person_pairs(matches: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """(left_key, right_key) of records of different sides in one component of ``matches``; ``repeats`` as in ``person_classes``."""
    pairs = member_pairs(cut(person_classes(matches, repeats)), "person")
    side = lambda c: F.substring_index(c, ":", 1)
    return pairs.where(side("left_key") != side("right_key"))
