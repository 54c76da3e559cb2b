"""What the sender of a mail newly wrote.

Two sources of evidence say that a line is not new. Its place in the mail: quote marks, headings
of quoted or forwarded mails, closing formula and signature, notices, list footers. And its
history: threads are put together from thread ids and dates, words of whole earlier mails are
hashed into rolling shingles, and runs of words that stood in earlier mails are inherited, however
they are marked. Below a heading without quote marks, history tells a reply from the quoted mail.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garner.session import cut, spread

# Closing formulas of letters, without marks and punctuation.
CLOSINGS = {
    "best", "best regards", "kind regards", "regards", "warm regards", "warmly", "many thanks", "thanks", "thank you", "thanks a lot", "cheers",
    "talk soon", "yours", "yours sincerely", "yours truly", "sincerely", "all the best", "best wishes", "take care", "see you", "see you soon", "love",
    "beste grusse", "viele grusse", "liebe grusse", "mit freundlichen grussen", "herzliche grusse", "schone grusse", "freundliche grusse", "gruss", "grusse",
    "lg", "vg", "mfg", "bis bald", "bis dann", "danke", "vielen dank", "ciao", "un abrazo", "abrazos", "saludos", "un saludo", "saludos cordiales",
    "un cordial saludo", "atentamente", "gracias", "hasta pronto", "besos", "bien a vous", "a bientot", "bises", "cordialement", "bien cordialement",
    "amicalement", "salutations", "merci", "merci d'avance", "sinceres salutations", "groeten", "groetjes", "met vriendelijke groet",
    "met vriendelijke groeten", "vriendelijke groet", "hartelijke groet", "tot gauw", "tot ziens", "mvg",
}

_WROTE = r"(?:wrote|writes|schrieb|schreef|escribió|escribio|a écrit|a ecrit|skrev|ha scritto)"
_ATTRIBUTION = (
    re.compile(rf"^(?:On|Am|Le|El|Op|Den|Il) .*\d.*{_WROTE}.*:\s*$", re.I),
    re.compile(rf"^-{{2,}} ?.*@.*{_WROTE}\s?:\s*$", re.I),
    re.compile(r"^Quoting .*(?:@|<).*:\s*$", re.I),
    re.compile(r"^\d{4}-\d\d-\d\d \d\d?:\d\d.*<[^<>]*@[^<>]*>\s?:\s*$"),
    re.compile(rf"^[^\W\d_].{{0,60}} {_WROTE} on \d{{4}}-\d\d-\d\d:\s*$"),
    re.compile(rf"^.{{0,80}}<[^<>\s]+@[^<>\s]+> {_WROTE}\s?:\s*$", re.I),
)
_OPENING = re.compile(r"^(?:On|Am|Le|El|Op|Den|Il) .*\d", re.I)
_OPENERS = {"on ", "am ", "le ", "el ", "op ", "den", "il "}
#: First letters and marks of the lines that open the headings of a quoted mail.
_HEADING_STARTS = set("-_*bBaAdDfFvV")
_BLOCK = re.compile(
    r"^\s*(?:-{2,}\s*(?:original message|urspr(?:ü|ue)ngliche nachricht|message d'origine|mensaje original|oorspronkelijk bericht|forwarded message|weitergeleitete nachricht|message transféré|mensaje reenviado|doorgestuurd bericht)\s*-{2,}|begin forwarded message\s*:|anfang der weitergeleiteten nachricht\s*:|début du message (?:réexpédié|transféré)\s*:)\s*$",
    re.I,
)
_FROM = re.compile(r"^\*?(?:From|Von|De|Van|Fra|Da)\*?\s?:.*(?:@|mailto)", re.I)
_FIELD = re.compile(r"^\*?(?:From|Von|De|Van|Sent|Gesendet|Envoyé|Enviado|Verzonden|Date|Datum|Fecha|To|An|À|Para|Aan|Cc|Subject|Betreff|Objet|Asunto|Onderwerp)\*?\s?:", re.I)
_DEVICE = re.compile(
    r"^(?:sent (?:from|via|with) (?:my |\w+)|sent on the go\b|get \w+ for |von mein\w* .*gesendet\b|gesendet (?:von|mit) |envoyé (?:depuis|de) |enviado (?:desde|con) |verzonden (?:vanaf|met) |diese nachricht wurde von mein)",
    re.I,
)
_NOTICE = re.compile(
    r"^(?:this (?:e-?mail|message|mail)\b.*\b(?:attach|intended|addressed|meant only|confidential(?![-\w]))|confidential(?:ity notice)?\s*:|views in this |the views expressed|diese (?:nachricht|e-?mail)\b.*\bvertraulich|ce (?:courriel|message)\b.*\bconfidentiel|este (?:mensaje|correo)\b.*\bconfidencial|dit bericht\b.*\bvertrouwelijk|please (?:think of|consider) the (?:trees|environment)|.*\bis registered under number\b|denken sie an die umwelt|pensez à l'environnement)",
    re.I,
)
_FOOTER = re.compile(r"^(?:\S+ mailing list\s*$|to (?:leave|unsubscribe from) (?:the|this) list\b|unsubscribe\b.*(?:@|http)|you (?:are receiving|received) this (?:mail|message|e-mail) because|liste abbestellen)", re.I)
_RULE = re.compile(r"^_{8,}\s*$")
_DELIMITER = re.compile(r"^(?:--|-- |__|___|~{3,}|\*{3}|—|––|={3,})\s*$")
_CONTACT = re.compile(r"(?:^(?:tel|phone|mobile|mobil|fon|m|t|f|fax|mail|e-?mail|web|skype)\b\s*[.:]?\s*(?=[+(\d]|\S+@|http|www)|^\+?[\d\s().\-/]{7,}$|^\S+@\S+$|^(?:https?://|www\.)\S+$)", re.I)
_QUOTED = re.compile(r"^\s{0,3}>")


def plain(line: str) -> str:
    """Lower case without marks, outer punctuation and repeated blanks."""
    text = unicodedata.normalize("NFKD", line.lower().replace("ß", "ss").replace("’", "'"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip(" ,.!;:–—-")


def _is_name(line: str) -> bool:
    words = line.strip().split()
    return 1 <= len(words) <= 4 and not re.search(r"[\d@:;,!?]|\.$", line) and all(w[0].isupper() or w in ("de", "van", "von", "del", "la", "den", "der") for w in words)


def _attribution(lines: list[str], i: int) -> int:
    """Number of lines of the attribution that starts at line i, or 0."""
    line = lines[i].strip()
    if line.endswith(":") and any(p.match(line) for p in _ATTRIBUTION):
        return 1
    if line[:3].lower() in _OPENERS and _OPENING.match(line):
        joined = line
        for n in (1, 2):
            if i + n >= len(lines) or not lines[i + n].strip():
                break
            joined += " " + lines[i + n].strip()
            if joined.endswith(":") and any(p.match(joined) for p in _ATTRIBUTION):
                return n + 1
    return 0


def _heading(lines: list[str], i: int) -> bool:
    """Whether the headings of a quoted mail start at line i; its text follows without marks."""
    line = lines[i].strip()
    if line[:1] not in _HEADING_STARTS:
        return False
    if _BLOCK.match(lines[i]):
        return True
    at = i
    if line[0] == "_" and _RULE.match(lines[i]):
        at = next((j for j in range(i + 1, min(i + 3, len(lines))) if lines[j].strip()), i)
        if at == i:
            return False
    return ":" in lines[at] and bool(_FROM.match(lines[at].strip())) and sum(bool(_FIELD.match(x.strip())) for x in lines[at + 1 : at + 5]) >= 1


def _signature_ahead(lines: list[str], i: int) -> bool:
    """Whether only short lines stand between line i and the end or the next quoted mail, as in a signature."""
    seen = 0
    for j in range(i, len(lines)):
        line = lines[j].strip()
        if not line:
            continue
        if _heading(lines, j) or _attribution(lines, j) or _QUOTED.match(lines[j]) or _RULE.match(line) or _NOTICE.match(line):
            break
        if _DEVICE.match(line) or _FOOTER.match(line) or _DELIMITER.match(line) or _CONTACT.search(line):
            continue
        seen += 1
        if seen > 6 or len(line) > 70 or (len(line.split()) > 4 and line[-1] in ".?!"):
            return False
    return True


def structural(body: str, sender: str = "") -> list[bool]:
    """For each line of ``body`` split at newlines, whether its place lets it be new text."""
    return placed(body, sender)[0]


def placed(body: str, sender: str = "", begun: bool = False) -> tuple[list[bool], int]:
    """``structural``, and the index of the first line below headings whose quoted mail has no marks, or -1.

    Lines from that one on are none of the new lines. ``begun``: something stands before ``body``.
    """
    lines = [x.rstrip("\r") for x in body.split("\n")]
    names = {plain(x) for x in (sender, sender.split()[0] if sender.split() else "") if x}
    new = [False] * len(lines)
    i, tail, mark = 0, False, ""
    # a signature stands behind something, so ``begun`` lets one come
    notice = False
    while i < len(lines):
        raw, line = lines[i], lines[i].strip()
        if not line:
            notice = False
            i += 1
            continue
        if _heading(lines, i):
            j = i + 1
            while j < len(lines) and (not lines[j].strip() or _FIELD.match(lines[j].strip())):
                j += 1
            if j >= len(lines) or not _QUOTED.match(lines[j]):
                return new, j if j < len(lines) else -1  # what follows without marks is the quoted or forwarded mail
            i, tail, mark, begun = j, False, ">", True
            continue
        if n := _attribution(lines, i):
            after = next((x for x in lines[i + n :] if x.strip()), "")
            mark = ">" if _QUOTED.match(after) else "|" if after.startswith("|") else " " if re.match(r"\s{2,}|\t", after) else ""
            if not mark and after:
                return new, i + n
            i, tail, begun = i + n, False, True
            continue
        if _QUOTED.match(raw) or (mark == "|" and raw.startswith("|")) or (mark == " " and re.match(r"\s{2,}|\t", raw)):
            tail, begun = False, True
            i += 1
            continue
        if notice:
            i += 1
            continue
        if _NOTICE.match(line):
            notice = True
            i += 1
            continue
        if _DEVICE.match(line) or _FOOTER.match(line):
            i += 1
            continue
        if _RULE.match(line) and any(_FOOTER.match(x.strip()) for x in lines[i + 1 : i + 3]):
            i += 1
            continue
        if tail:
            i += 1
            continue
        closing = plain(line) in CLOSINGS and len(line) < 40 and not line.endswith(("!", "?"))
        if closing and _signature_ahead(lines, i + 1):
            tail = True
        elif _DELIMITER.match(line) and _signature_ahead(lines, i + 1):
            tail = True
        elif (plain(line) in names or _is_name(raw)) and not line.endswith((",", ":")) and (i == 0 or not lines[i - 1].strip() or plain(lines[i - 1]) in CLOSINGS) and begun and _signature_ahead(lines, i + 1):
            tail = True
        elif _CONTACT.search(line) and begun and not lines[i - 1].strip() and _signature_ahead(lines, i + 1):
            tail = True
        else:
            new[i] = begun = True
        i += 1
    return new, -1


def replies_below(lines: list[str], sender: str, seen: set[int]) -> list[int]:
    """Indexes of the new lines among ``lines`` below headings without marks; ``seen``: those the thread's earlier mails have.

    What stands before the first of those, has no words or has no place among new lines is not new.
    """
    rest = ["" if i in seen or i < min(seen) else x for i, x in enumerate(lines)]
    return [i for i, x in enumerate(placed("\n".join(rest), sender, begun=True)[0]) if x and words_of(rest[i])]


_WORD = re.compile(r"[^\W_]+")


def words_of(line: str) -> list[str]:
    """Words of a line without its quote marks."""
    return _WORD.findall(re.sub(r"^[\s>|]+", "", line).lower())


def _codes(words: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh64_intdigest(w)
        out.append(c)
    return out


def _roll(codes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rolling polynomial hashes, modulo 2^64, of every run of ``size`` codes, for all places at once."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(base) + codes[k : k + n]
    return h


def rolling_shingles(words: list[str], size: int) -> list[int]:
    """Rolling hashes of every run of ``size`` words."""
    return _roll(np.array(_codes(words, {}), np.uint64), size).tolist()


#: Words of a shingle and words in a row from which text counts as inherited.
SHINGLE, LEAST_RUN = 5, 9
#: A shingle is a stock phrase if it returns in more than this share of the threads, and in more than so many.
STOCK, STOCK_LEAST = 0.001, 3
#: Characters of a thread up to which one task reads it whole; longer threads are joined shingle by shingle.
WHOLE_THREAD = 2_000_000

_READ = "id string, thread string, at long, sender string, body string, kept array<int>, below int, counts array<int>, hashes array<long>, known array<int>, fresh array<long>, leads boolean"


def _mail_shingles(rows: pd.DataFrame) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per mail kept lines, first line below headings and words per line; for all shingles the hash, mail, place and whether later mails can have it from there.

    Quoted lines of a mail without a time tell nothing of what later mails have, as the quoted mail
    may be the one that seems later.
    """
    mails, codes, owner, place, source = [], [], [], [], []
    vocabulary: dict[str, int] = {}
    for k, (body, sender, at) in enumerate(zip(rows["body"], rows["sender"], rows["at"], strict=True)):
        new, below = placed(body, sender or "")
        words, counts = [], []
        for line in body.split("\n"):
            w = _WORD.findall(line.lower())
            words += w
            counts.append(len(w))
        mails.append({"kept": [i + 1 for i, x in enumerate(new) if x], "below": below + 1, "counts": counts})
        n = max(0, len(words) - SHINGLE + 1)
        if n:
            codes.append(_roll(np.array(_codes(words, vocabulary), np.uint64), SHINGLE))
            owner.append(np.full(n, k))
            place.append(np.arange(n))
            if at > 0:
                source.append(np.ones(n, bool))
            else:
                own = np.repeat(np.array(new), counts)
                source.append(own[:n] & own[SHINGLE - 1 :])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return mails, join(codes, np.uint64).view(np.int64), join(owner, int), join(place, int), join(source, bool)


def _whole_threads(rows: pd.DataFrame) -> pd.DataFrame:
    """``_READ`` rows of mails, all threads of which are complete: a shingle is known if an earlier mail of the thread, by (at, id), has it."""
    rows = rows.sort_values(["thread", "at", "id"], kind="stable", ignore_index=True)
    mails, hashes, owner, place, source = _mail_shingles(rows)
    thread = pd.factorize(rows["thread"])[0]
    known, fresh = [[] for _ in mails], [[] for _ in mails]
    if len(hashes):
        order = np.lexsort((owner, hashes, thread[owner]))
        h, o, s = hashes[order], owner[order], source[order]
        begins = np.r_[True, (h[1:] != h[:-1]) | (thread[o[1:]] != thread[o[:-1]])]
        group = np.cumsum(begins) - 1
        first = np.full(group[-1] + 1, len(rows))
        np.minimum.at(first, group[s], o[s])
        hit = first[group] < o
        again = order[hit]
        by_mail = np.lexsort((place[again], owner[again]))
        again = again[by_mail]
        cuts = np.searchsorted(owner[again], np.arange(len(rows) + 1))
        known = [place[again[i:j]] for i, j in itertools.pairwise(cuts)]
        # every known shingle counts once a thread, with the first mail that has it from another
        at = np.unique(group[hit], return_index=True)[1]
        by_lead = at[np.argsort(o[hit][at], kind="stable")]
        cuts = np.searchsorted(o[hit][by_lead], np.arange(len(rows) + 1))
        value = h[hit][by_lead]
        fresh = [value[i:j] for i, j in itertools.pairwise(cuts)]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1)) if len(hashes) else np.zeros(len(rows) + 1, int)
    out = pd.DataFrame(mails)
    out["hashes"] = [hashes[i:j] if len(k) else [] for (i, j), k in zip(itertools.pairwise(starts), known, strict=True)]
    out["known"], out["fresh"] = known, fresh
    out["leads"] = np.r_[True, thread[1:] != thread[:-1]][: len(rows)]
    for c in ("id", "thread", "at", "sender", "body"):
        out[c] = rows[c]
    return out[[c.split()[0] for c in _READ.split(", ")]]


def read_threads(mails: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``_READ`` rows of every mail: its structure, its shingles, and the places of those that earlier mails of the thread have.

    Threads of up to ``WHOLE_THREAD`` characters are read by one task each, many threads to a
    batch. Mails of the longer threads ``hot`` are spread, and their shingles meet in a join whose
    aggregation combines before it shuffles. Both ways give the same.
    """
    ordinary = mails if hot is None else mails.join(hot, "thread", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b["thread"] == b["thread"].iloc[-1]).to_numpy() if len(b) else np.zeros(0, bool)
            held = b[last]
            if not last.all():
                yield _whole_threads(b[~last])
        if held is not None and len(held):
            yield _whole_threads(held)

    grouped = spread(ordinary, "thread").sortWithinPartitions("thread")
    read = cut(grouped.select("id", "thread", "at", "sender", "body").mapInPandas(run, _READ))
    return read if hot is None else read.unionByName(cut(_long_threads(mails.join(hot, "thread", "left_semi"))))


def _long_threads(mails: DataFrame) -> DataFrame:
    """``_READ`` rows of mails of threads too long for one task."""
    schema = _READ + ", source array<boolean>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, hashes, owner, _, source = _mail_shingles(b)
            at = np.searchsorted(owner, np.arange(len(b) + 1))
            out = pd.DataFrame(found, columns=["kept", "below", "counts"])
            out["hashes"], out["source"] = [hashes[i:j] for i, j in itertools.pairwise(at)], [source[i:j] for i, j in itertools.pairwise(at)]
            out["known"], out["fresh"], out["leads"] = [[] for _ in found], [[] for _ in found], False
            for c in ("id", "thread", "at", "sender", "body"):
                out[c] = b[c].to_numpy()
            yield out[[c.split()[0] for c in schema.split(", ")]]

    read = cut(spread(mails, "id").select("id", "thread", "at", "sender", "body").mapInPandas(run, schema))
    spans = read.select("thread", "id", "at", F.posexplode(F.arrays_zip("hashes", "source")).alias("place", "s")).select("thread", "id", "at", "place", "s.*")
    first = spans.where("source").groupBy("thread", "hashes").agg(F.min(F.struct("at", "id")).alias("f"))
    known = spans.join(first, ["thread", "hashes"]).where("f < struct(at, id) and f.id <> id")
    fresh = known.groupBy("thread", "hashes").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("hashes").alias("fresh"))
    places = known.groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("known"))
    leads = read.groupBy("thread").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("leads"))
    rest = read.drop("known", "fresh", "leads", "source")
    full = rest.join(places, "id", "left").join(fresh, "id", "left").join(leads, "id", "left")
    return full.select([F.coalesce(c, F.array().cast(t)).alias(c) if c in ("known", "fresh") else F.coalesce(c, F.lit(False)).alias(c) if c == "leads" else F.col(c) for c, t in (x.split() for x in _READ.split(", "))])


def stock_phrases(read: DataFrame) -> np.ndarray:
    """Sorted hashes that return in more than ``STOCK`` of the threads.

    A thread gives each of its returning shingles once, so there are at most (returning shingles
    of an average thread) / ``STOCK`` of them, however many threads there are.
    """
    threads = read.agg(F.count_if("leads")).first()[0]
    often = read.select(F.explode("fresh").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(STOCK_LEAST, STOCK * threads))
    return np.sort(often.select("hash").toPandas()["hash"].to_numpy(np.int64))


def inherited(counts: np.ndarray, hashes: np.ndarray, known: np.ndarray, stock: np.ndarray) -> tuple[set[int], set[int]]:
    """Numbers of the lines that stand in earlier mails, and of those among them that are inherited.

    Known shingles one after the other are a run: it holds every alignment with any one earlier
    mail, and those that several of them share out. Lines of which known shingles cover 0.8 of the
    words are given; inherited are those where runs of ``LEAST_RUN`` words or more without stock
    phrases do.
    """
    line = np.repeat(np.arange(1, len(counts) + 1), counts)
    at = np.searchsorted(stock, hashes[known])  # stock is sorted
    common = stock[np.minimum(at, len(stock) - 1)] == hashes[known] if len(stock) else np.zeros(len(known), bool)
    rare = known[~common]
    run = np.cumsum(np.r_[True, np.diff(rare) != 1]) if len(rare) else np.zeros(0, int)
    long = rare[np.bincount(run)[run] + (SHINGLE - 1) >= LEAST_RUN] if len(rare) else rare

    def ends(places: np.ndarray) -> np.ndarray:
        # first and last words of all shingles of a run are together all its words
        words = np.unique(np.r_[places, places + (SHINGLE - 1)])
        return np.bincount(line[words], minlength=len(counts) + 1)[1:]

    return set((np.flatnonzero((counts > 0) & (ends(known) >= 0.8 * counts)) + 1).tolist()), set((np.flatnonzero((counts > 0) & (ends(long) >= 0.8 * counts)) + 1).tolist())


PATHS = ("new", "alignment", "both", "structure")


def message_lines(mails: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(message_id, line_no, path) of every non-blank line; line_no counts from 1.

    ``path``: new, or what tells that it isn't: the alignment with earlier mails of the thread, its
    place in the mail (structure), or both. ``mails``: id, thread, at, sender, body; one row per
    mail. Null and blank bodies have no lines; a null thread is a thread of its own; a null time
    comes first. ``hot``: threads of more than ``WHOLE_THREAD`` characters; found here if not given.
    """
    alone = F.concat(F.lit("\0"), "id")
    mails = mails.where("body is not null").select("id", F.coalesce("thread", alone).alias("thread"), F.coalesce("at", F.lit(0)).alias("at"), "sender", "body")
    if hot is None:
        hot = long_threads(mails.select("thread", "body"))
    read = read_threads(mails, None if hot.isEmpty() else hot)
    context = mails.sparkSession.sparkContext
    shared = context.broadcast(stock_phrases(read))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stock = shared.value
        for b in batches:
            ids, numbers, paths = [], [], []
            for i, sender, body, kept, below, counts, hashes, known in zip(b["id"], b["sender"], b["body"], b["kept"], b["below"], b["counts"], b["hashes"], b["known"], strict=True):
                seen, old = inherited(counts, hashes, known, stock) if len(known) else ((), ())
                lines = body.split("\n")
                new = set(kept) - set(old)
                if below > 0 and any(n >= below for n in old):
                    new |= {below + k for k in replies_below(lines[below - 1 :], sender or "", {x - below for x in seen if x >= below})}
                placed_new = set(kept)
                for n, line in enumerate(lines, 1):
                    if line.strip():
                        ids.append(i)
                        numbers.append(n)
                        paths.append("new" if n in new else "structure" if n not in old else "alignment" if n in placed_new else "both")
            yield pd.DataFrame({"message_id": ids, "line_no": numbers, "path": paths})

    return read.select("id", "sender", "body", "kept", "below", "counts", "hashes", "known").mapInPandas(run, "message_id string, line_no int, path string")


def long_threads(rows: DataFrame) -> DataFrame:
    """Threads of more than ``WHOLE_THREAD`` characters; ``rows``: thread, body. Null threads are none."""
    sizes = rows.where("thread is not null").groupBy("thread").agg(F.sum(F.length("body")).alias("size"))
    return sizes.where(F.col("size") > WHOLE_THREAD).select("thread")


def message_new_lines(mails: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(message_id, line_no) of the newly written non-blank lines, as ``message_lines`` tells them."""
    return message_lines(mails, hot).where("path = 'new'").select("message_id", "line_no")
