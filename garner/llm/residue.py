"""Records in which no real content arrived: unfilled fields, filler, error pages, script notices.

Positive-unlabelled naive Bayes. Passages that match a trusted whole form are positive; all others
are unlabelled. Expectation-maximisation then shares the unlabelled passages between both classes
by their words, over all passages of the corpus. Features are hashed into a fixed number of
buckets, so the model is two vectors of bounded size however large the corpus grows.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garner.session import cut, spread

BUCKETS = 1 << 18
#: Share of the positive counts by which the corpus' own word frequencies smooth both classes.
SMOOTH = 0.1
ROUNDS = 4
DECIDE = 0.9

# Ways of writing a template field.
FIELD = re.compile(
    r"\{\{\{?[#/]?[^{}\n]{1,60}\}?\}\}|\$\{[^{}\n]{1,40}\}|\{\$[^{}\n]{1,40}\}|#\{[^{}\n]{1,40}\}|\[\[[^\[\]\n]{1,40}\]\]|<<[^<>\n]{1,40}>>|<%=?[^<>\n]{1,60}%>|\*\|[A-Za-z_:\- ]{1,40}\|\*"
    r"|@@[A-Za-z_ ]{1,40}@@|__[A-Z][A-Z_]{1,40}__|(?<![\w%])%[A-Z][A-Z_]{1,40}%(?!\w)|\[(?:insert|enter|your|add|type)\b[^\[\]\n]{1,40}\]|\[[A-Z]{3,}(?:[ _][A-Z]+)*\]|(?<![\w$#{])\{(?:\d|[a-z]+(?:_[a-z]+)*)\}"
    r"|\bINSERT_[A-Z_]{1,40}_HERE\b|\[object Object\]|(?<!\w)%\([a-z_]+\)s",
    re.I,
)
_CASED = re.compile(r"^(?:__|%|\[[A-Z])")

# Whole passages that error pages, notices and forms consist of.
TRUSTED = [
    r"(?:http/\d(?:\.\d)? )?[45]\d\d (?:bad request|unauthorized|forbidden|not found|gone|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out|request timeout)\.?",
    r"(?:http )?error (?:code )?[45]\d\d\b.{0,60}",
    r"\{\"(?:error|errors|message|status)\":.*\}",
    r"traceback\b.*",
    r"(?:[a-z_.]*(?:error|exception)): .{3,80}",
    r"upstream connect error.*",
    r"something went wrong\b.{0,40}",
    r"(?:er is iets misgegaan|etwas ist schiefgelaufen|une erreur (?:est survenue|s'est produite)|algo salio mal|ha ocurrido un error)\b.{0,40}",
    r"(?:erreur interne du serveur|interner serverfehler|error interno del servidor|interne serverfout|internal server error)\.?",
    r"(?:the )?page (?:you (?:asked|are looking|requested)\b.{0,40}|not found\.?)",
    r"the (?:address|page|file) you (?:asked for|requested) (?:could not be|was not|cannot be) .{0,40}",
    r"(?:seite nicht gefunden|page introuvable|page non trouvee|pagina niet gevonden|no se encontro la pagina.{0,30}|pagina no encontrada|die seite wurde nicht gefunden)\.?",
    r"(?:access denied|permission denied|zugriff verweigert|acces refuse|acceso denegado|toegang geweigerd)\.?",
    r"(?:your session has expired|ihre sitzung ist abgelaufen|votre session a expire|su sesion ha (?:caducado|expirado)|uw sessie is verlopen)\.?",
    r"please (?:sign|log) in again\b.{0,30}",
    r"(?:sorry,? )?(?:the|this) [a-z]+(?: [a-z]+)? (?:is (?:temporarily|currently) unavailable|(?:cannot|can't|could not|couldn't) be (?:shown|displayed|loaded|opened|found))(?: right now| at the moment)?\.?",
    r"(?:sorry,? )?(?:we|i) (?:cannot|can't|could not|couldn't) (?:find|load|open|show|display) (?:that|this|the) (?:page|file|content|document|address)\.?",
    r".{0,30}\b(?:please )?(?:enable|allow|turn on|activate) (?:javascript|js|scripts|scripting|cookies) (?:to|in|for)\b.{0,50}",
    r"(?:bitte )?aktivieren sie (?:javascript|js|scripts|scripting|skripte|cookies)\b.{0,50}",
    r"(?:veuillez|merci d')\s*activer (?:javascript|js|(?:les )?scripts|scripting)\b.{0,40}",
    r"(?:debe habilitar|active|habilite) (?:javascript|js|(?:los )?scripts|scripting)\b.{0,40}",
    r"zet (?:javascript|js|scripts|scripting) aan\b.{0,40}",
    r"(?:javascript|js|scripts|scripting) (?:is|are) (?:disabled|switched off|turned off|required)\b.{0,40}",
    r"your browser does not support (?:javascript|js|scripts|scripting)\b.{0,40}",
    r"this (?:mail reader|app|page|site|viewer) (?:needs|requires) (?:javascript|js|scripts|scripting)\b.{0,20}",
    r".{0,50}\b(?:doesn't|does not|won't|will not) work (?:properly )?without (?:javascript|js|scripts|scripting)\b.{0,30}",
    r"you need to (?:enable|allow) (?:javascript|js|scripts|scripting)\b.{0,30}",
    r"lorem ipsum\b(?: [a-z]+){3,}\.?",
    r"(?:sample text|body text|placeholder|tbd|xxx|asdf|qwerty|blah|test|dummy)(?:[ ,]+(?:sample text|body text|placeholder|tbd|xxx|asdf|jkl|qwerty|blah|test|dummy))+\.?",
    r"placeholder (?:paragraph|text)\b.{0,40}",
    r"(?:your |the )?(?:title|text|subtitle|body|content) goes here\b.{0,30}",
    r"(?:hier steht ihr text|hier komt de tekst|texte a remplacer|texto de ejemplo|beispieltext, bitte ersetzen|escriba aqui su texto|saisissez votre texte ici|votre texte ici|voorbeeldtekst)\.?",
    r"(?:click|tap) (?:here )?to (?:edit|add)\b.{0,30}",
    r"add a (?:short )?description\b.{0,30}",
    r"type something\b.{0,20}",
    r"untitled(?: (?:body text|document|note|text))*",
]


def compiled(forms: list[str]) -> re.Pattern:
    """One pattern of all forms."""
    return re.compile("|".join(f"(?:{x})" for x in forms))


_TRUSTED = compiled(TRUSTED)
_QUOTES = {"'": "'", '"': '"', "`": "`", "„": "“", "“": "”", "«": "»", "‘": "’"}
_SPLIT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|\s+\|\s+")
_TOKEN = re.compile(r"<field>|<quoted>|<path>|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[{}\[\]<>$%#/:?!]")
_PREFIX = re.compile(r"^(?:[>|*\-•]+|\[[ x]\]|\d+[.)])\s+")
_SPEAKER = re.compile(r"^(?:me|them|[A-Z]\w+):\s+")
#: Every template field has one of these signs.
_SIGN = re.compile(r"[{\[<$%#@*_]")


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, without list marks."""
    return [q for p in _SPLIT.split(text) if (q := _PREFIX.sub("", p.strip()).strip())]


def _field(m: re.Match, text: str) -> str:
    value = m[0]
    if re.match(r"__|%[^(]|\[[^\[\]]+\]$", value) and not re.match(r"\[\[|\[(?:insert|enter|your|add|type)\b|\[object", value, re.I):
        inner = value.strip("_%[]")
        if inner != inner.upper():
            return value  # only written in capitals it is a field
    before, after = text[: m.start()], text[m.end() :]
    if after[:1] and after[0] in "/\\":
        return " <path> "
    if before[-1:] in _QUOTES and after[:1] == _QUOTES[before[-1]]:
        return " <quoted> "
    return " <field> "


def features(passage: str, forms: re.Pattern = _TRUSTED) -> tuple[list[int], bool]:
    """Hashed words and pairs of words of a passage, and whether it has a trusted form, with its speaker's name or without."""
    shown = FIELD.sub(lambda m: _field(m, passage), passage) if _SIGN.search(passage) else passage
    low = shown.lower().replace("’", "'")
    bare = low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    tokens = ["9" if t.isdigit() else t for t in _TOKEN.findall(low)]
    words = sum(t[0].isalpha() for t in tokens)
    fields = tokens.count("<field>")
    trusted = bool(forms.fullmatch(bare.strip())) or (fields > 0 and words <= 8 and "<quoted>" not in tokens) or fields > 2
    if not trusted and (speaker := _SPEAKER.match(passage)):
        trusted = bool(forms.fullmatch(bare[len(speaker[0]) :].strip()))
    ends = ["^", *tokens, "$"]
    return sorted({_bucket(x) for x in (*tokens, *map(" ".join, itertools.pairwise(ends)))}), trusted


@lru_cache(1 << 17)
def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def passage_table(documents: DataFrame, forms: list[str] = TRUSTED) -> DataFrame:
    """(doc_id, key, trusted, ids) of every passage. ``documents``: doc_id, text; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = compiled(forms)
        for b in batches:
            docs, keys, flags, lists, seen = [], [], [], [], {}
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                for p in passages(text):
                    if (got := seen.get(p)) is None:
                        ids, trusted = features(p, pattern)
                        ids = np.array(ids, np.int32)
                        got = seen[p] = (xxhash.xxh64_intdigest(ids.tobytes()) - (1 << 63), trusted, ids)
                    if len(got[2]):
                        for column, value in zip((docs, keys, flags, lists), (i, *got), strict=True):
                            column.append(value)
            yield pd.DataFrame({"doc_id": docs, "key": keys, "trusted": flags, "ids": lists})

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, key long, trusted boolean, ids array<int>")


def _chance(ids: pd.Series, weights: np.ndarray, offset: float) -> np.ndarray:
    """Probabilities under the model of a batch of passages, none of which is without features."""
    if not len(ids):
        return np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(ids.map(len).to_numpy())[:-1]])
    logit = offset + np.add.reduceat(weights[np.concatenate(ids.to_list())], starts)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _counts(kinds: DataFrame, weights: np.ndarray | None, offset: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Feature counts and passage weights of both classes, with posteriors under ``weights``.

    Every task sends sums per bucket, at most ``BUCKETS`` rows, which are added up before the two
    vectors of ``BUCKETS`` numbers reach the driver.
    """
    shared = kinds.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        w = shared.value
        for b in batches:
            if not len(b):
                continue
            n, trusted = b["n"].to_numpy(float), b["trusted"].to_numpy(bool)
            p = np.where(trusted, 1.0, 0.0 if w is None else _chance(b["ids"], w, offset))
            each, ids = b["ids"].map(len).to_numpy(), np.concatenate(b["ids"].to_list())
            for out, weight in ((pos, n * p), (neg, n * (1 - p))):
                out[:-1] += np.bincount(ids, np.repeat(weight, each), BUCKETS)
                out[-1] += weight.sum()
        at = np.flatnonzero(pos + neg)
        yield pd.DataFrame({"bucket": at, "pos": pos[at], "neg": neg[at]})

    sums = kinds.select("ids", "trusted", "n").mapInPandas(run, "bucket int, pos double, neg double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    pos[sums["bucket"]], neg[sums["bucket"]] = sums["pos"], sums["neg"]
    shared.unpersist()
    return pos[:-1], neg[:-1], pos[-1], neg[-1]


def learn(kinds: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log odds per bucket and the prior's log odds, by expectation-maximisation over ``kinds``.

    ``kinds``: ids, trusted, n; one row per distinct passage. Without trusted passages nothing can
    be learned: all weights are 0 and the prior rules everything out.
    """
    weights, offset = None, 0.0
    for _ in range(rounds):
        pos, neg, n_pos, n_neg = _counts(kinds, weights, offset)
        if not n_pos or not n_neg:
            return np.zeros(BUCKETS), -50.0 if not n_pos else 50.0
        background = (pos + neg + 1e-3) / (pos + neg + 1e-3).sum()
        kappa = SMOOTH * pos.sum()
        p = (pos + kappa * background) / (pos.sum() + kappa)
        q = (neg + kappa * background) / (neg.sum() + kappa)
        weights, offset = np.log(p / q), float(np.log(n_pos / n_neg))
    return weights, offset


def score(kinds: DataFrame, weights: np.ndarray, offset: float) -> DataFrame:
    """(key, p): the probability that a passage is residue. Trusted passages are scored like all others: their forms are labels to learn from, not answers."""
    shared = kinds.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "p": _chance(b["ids"], w, offset)})

    return kinds.select("key", "ids").mapInPandas(run, "key long, p double")


def residue_records(documents: DataFrame, decide: float = DECIDE, forms: list[str] = TRUSTED) -> DataFrame:
    """(doc_id, p) of the documents that hold residue: one passage or several of them make it likely.

    ``documents``: doc_id, text; ``forms``: the trusted forms to learn from. A document's probability joins those of its passages: it holds
    residue unless none of them does. Null and empty texts are never returned.
    """
    rows = cut(passage_table(spread(documents.select("doc_id", "text"), "doc_id"), forms))
    kinds = cut(rows.groupBy("key").agg(F.first("ids").alias("ids"), F.max("trusted").alias("trusted"), F.count("*").alias("n")))
    scored = score(kinds, *learn(kinds)).where("p > 0.01")
    none = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12))))
    return rows.select("doc_id", "key").join(scored, "key").groupBy("doc_id").agg((1 - F.exp(none)).alias("p")).where(F.col("p") >= decide)
