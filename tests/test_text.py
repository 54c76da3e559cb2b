"""Search, matching, aliases, streams and merges on small cases."""

import hashlib

from pyspark.sql import functions as F

from garner.functions.matching import match_rank
from garner.functions.text import human_name, phone_key, slug
from garner.operators import aliases, fulltext
from garner.operators.ingest import fold_duplicates, is_stale, merge_columns, snapshot_changes, source_state


def test_match_ranks(spark):
    cases = [
        ("alex lee", "Alex-Lee", 4), ("alex", "alexandra", 3), ("lex", "alexandra", 2), ("alex", "alec", 1), ("jhon", "john", 1), ("danil", "daniel", 1), ("jeff", "jef", 1),
        ("ozge", "Özge", 1), ("oscar", "Øscar", 1), ("daniel", "angel", None), ("daniel", "panel", None), ("jo", "bo", None), ("bob example", "Alice Example", None), ("", "x", None), ("x", None, None),
    ]
    df = spark.createDataFrame(cases, "q string, v string, want int")
    assert [r for r in df.withColumn("got", match_rank(F.col("q"), F.col("v"))).collect() if r["got"] != r["want"]] == []


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("Ann", "1"), ("...", "1"), ("+1 555 01", "1"), ("unknown", "1"), ("x@y", "X@Y"), (None, None)], "n string, i string")
    assert [r[0] for r in df.select(human_name(F.col("n"), F.col("i"))).collect()] == ["Ann", None, None, None, None, None]
    df = spark.createDataFrame([("+44 (0)755 123456",), ("0049 30 1234567",), ("(555) 010-0",), ("440123",)], "p string")
    assert [r[0] for r in df.select(phone_key(F.col("p"))).collect()] == ["44755123456", "49301234567", "5550100", "440123"]
    assert spark.range(1).select(slug(F.lit("  Ünal O'Neill.Jr ")), slug(F.lit("??"))).first() == ("ünal-o-neill-jr", "person")


def test_phrases_and_marks(spark):
    docs = spark.createDataFrame([(1, "scope upgrade"), (2, "scope filler upgrade"), (3, "Café_2 Scope-Upgrade!"), (4, None), (5, "")], "id int, t string")
    find = lambda p: sorted(r["id"] for r in docs.where(fulltext.matches([F.col("t")], p)).collect())
    assert find(fulltext.terms("scope-upgrade")) == [1, 3]
    assert find(fulltext.tokens("scope-upgrade")) == [1, 2, 3]
    assert find(fulltext.tokens("cafe_2")) == [3]
    assert find(fulltext.terms("?!")) == []
    index = fulltext.postings(docs, "id", "t")
    assert {r["id"]: r["hits"] for r in fulltext.phrase_hits(index, "id", ["scope", "upgrade"]).collect()} == {1: 1, 3: 1}
    shown = spark.range(1).select(fulltext.marked(F.lit("Weather, weathered WEATHER"), ["weather"]).alias("m"))
    got = shown.select(fulltext.runs(F.col("m")).alias("r")).first()["r"]
    assert [(x["text"], x["matched"]) for x in got] == [("Weather", True), (", weathered ", False), ("WEATHER", True)]
    assert spark.range(1).select(fulltext.runs(F.lit("ab")).alias("r")).first()["r"] is None


def test_rank_prefers_short_and_frequent(spark):
    docs = spark.createDataFrame([(1, "fox " * 3 + "end"), (2, "fox " + "word " * 40), (3, "none at all"), (4, "still none"), (5, "nothing")], "id int, t string")
    got = [r["id"] for r in fulltext.bm25(docs, "id", "t", fulltext.tokens("fox")).orderBy(F.desc("score")).collect()]
    assert got == [1, 2]


def test_fragment():
    text = "word " * 400 + "better days " + "tail " * 400
    cut = fulltext.fragment(text, "better")
    assert len(cut) <= 1000 and "better days" in cut and set(cut.split()) <= {"word", "better", "days", "tail"}
    assert fulltext.fragment("  a \n b ", "a") == "a b"
    assert fulltext.fragment("", "a") == ""
    assert len(fulltext.fragment("x" * 3000, "q")) == 1000


def test_aliases(spark):
    refs = [f"ref/{i}" for i in range(3000)]
    df = spark.createDataFrame([(r,) for r in [*refs, refs[0], None]], "r string")
    got = {r["full_ref"]: r["alias"] for r in aliases.build(df, "r").collect()}
    start = aliases.default_length(len(refs))

    def digits(r):
        v, out = int(hashlib.sha256(f"sr1|{r}".encode()).hexdigest(), 16), ""
        while len(out) < 52:
            v, d = divmod(v, 31)
            out += aliases.ALPHABET[d]
        return out

    want = {}
    sizes = dict.fromkeys(refs, start)
    while True:
        groups = {}
        for r in refs:
            groups.setdefault(digits(r)[: sizes[r]], []).append(r)
        clash = [r for g in groups.values() if len(g) > 1 for r in g]
        if not clash:
            break
        for r in clash:
            sizes[r] += 1
    want = {r: digits(r)[: sizes[r]] for r in refs}
    assert got == want and len(set(got.values())) == len(refs)
    assert aliases.build(spark.createDataFrame([], "r string"), "r").count() == 0
    assert [aliases.default_length(n) for n in (0, 1, 572_584, 572_585)] == [5, 5, 5, 6]
    links = spark.createDataFrame([("x:23456",), ("x:2345",), ("X:23456",), ("x:2345l",)], "l string")
    assert [r[0] for r in links.select(aliases.parse_link(F.col("l")).isNotNull()).collect()] == [True, False, False, False]


def test_merges(spark):
    old = spark.createDataFrame([("a", "x", 5), ("b", "y", None)], "k string, t string, n int")
    new = spark.createDataFrame([("a", " ", 3), ("c", "z", 1)], "k string, t string, n int")
    assert sorted(merge_columns(old, new, "k", ["t"], ["n"]).collect(), key=lambda r: r["k"]) == [("a", "x", 5), ("b", "y", None), ("c", "z", 1)]
    assert {r["k"]: r["change"] for r in snapshot_changes(old, new, "k", ["t", "n"]).collect()} == {"a": "changed", "b": "deleted", "c": "new"}
    dup = spark.createDataFrame([("a", 1, "", 2, False), ("a", 2, "x", 1, True), ("a", 3, "y", None, None)], "k string, o int, t string, n int, f boolean")
    assert fold_duplicates(dup, "k", ["o"], ["t"], ["n"], ["f"]).collect() == [("a", "x", 2, True)]
    seen = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, True), ("b", 2, False), ("c", 1, None)], "k string, t int, gone boolean")
    got = {r["k"]: (r["state"], r["first_missing"]) for r in source_state(seen, "k", "t", F.col("gone")).collect()}
    assert got == {"a": ("deleted_upstream", 2), "b": ("current", None), "c": ("current", None)}
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ages = spark.range(1).select(is_stale(F.lit(None).cast("timestamp"), now, 5), is_stale(now, now, 0), is_stale(F.lit("2024-01-01 00:00:00").cast("timestamp"), now, 60))
    assert ages.first() == (True, False, True)
