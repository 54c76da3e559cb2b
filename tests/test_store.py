"""The store, sources, settings, streams that go on, and identity over records, on small tables."""

import pytest

from garner.api import AmbiguousPerson, Archive
from garner.config import parse_settings
from garner.operators import identity, ingest
from garner.operators.store import Store
from garner.sources.registry import RECORD, Registry, Source
from garner.streaming.pages import page_loop, stream_table
from garner.streaming.progress import listen


def rows(spark, values, schema="key string, text string"):
    return spark.createDataFrame(values, schema)


def test_snapshots_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None and store.version("t") == 0
    changes = lambda df, at: {r["change"]: r["n"] for r in store.apply_snapshot("t", df, "key", at).collect()}
    assert changes(rows(spark, [("a", "1"), ("b", None)]), "2024-01-01") == {"new": 2}
    assert changes(rows(spark, [("a", "1"), ("b", "")]), "2024-01-02") == {"unchanged": 1, "changed": 1}
    assert changes(rows(spark, [("c", "x")]), "2024-01-03") == {"new": 1, "deleted": 2}
    assert changes(rows(spark, [("a", "1"), ("c", "x")]), "2024-01-04") == {"new": 1, "unchanged": 1}
    got = {r["key"]: (str(r["changed_at"])[:10], r["deleted_at"] is None) for r in store.read("t").collect()}
    assert got == {"a": ("2024-01-04", True), "b": ("2024-01-02", False), "c": ("2024-01-03", True)}
    assert changes(rows(spark, []), "2024-01-05") == {"deleted": 2}
    for n in range(6):
        store.replace("u", rows(spark, [(str(n), "x")]))
    assert store.version("u") == 6 and [r["key"] for r in store.read("u").collect()] == ["5"]
    assert len(list((tmp_path / "u" / "data").iterdir())) <= 4


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", rows(spark, [("a", "1")]))
    rows(spark, [("half", "1")]).write.parquet(f"{tmp_path}/t/data/2")
    assert [r["key"] for r in store.read("t").collect()] == ["a"]
    store.replace("t", rows(spark, [("b", "1")]))
    assert [r["key"] for r in store.read("t").collect()] == ["b"]


def test_aliases_given_once_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.update_aliases(rows(spark, [(f"x/{i}", "") for i in range(50)]), "key")
    before = {r["full_ref"]: r["alias"] for r in store.read("aliases").collect()}
    store.update_aliases(rows(spark, [(f"x/{i}", "") for i in range(4000)]), "key")
    after = {r["full_ref"]: r["alias"] for r in store.read("aliases").collect()}
    assert before.items() <= after.items() and len(set(after.values())) == len(after) == 4000
    assert store.references(before["x/3"]) == ["x/3"] and store.references("zzzzzzzzz") == []


def test_words_and_lag(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    texts = rows(spark, [("a", "one two"), ("b", None), ("c", "")])
    assert store.index_lag("t", texts, "key", "text") == 1
    store.index_texts("t", texts, "key", "text")
    assert store.index_lag("t", texts, "key", "text") == 0
    assert {(r["key"], r["word"]) for r in store.read("t_words").collect()} == {("a", "one"), ("a", "two")}


def test_archive_update_and_links(spark, data, tmp_path):
    archive = Archive(spark, data, Store(spark, str(tmp_path)))
    first = {(r["source"], r["change"]): r["n"] for r in archive.update("2024-01-01", ("posts", "notes")).collect()}
    assert set(k for _, k in first) == {"new"} and {s for s, _ in first} == {"posts", "notes"}
    again = {(r["source"], r["change"]): r["n"] for r in archive.update("2024-01-02", ("posts", "notes")).collect()}
    assert again == {(s, "unchanged"): n for (s, _), n in first.items()}
    one = archive.links("posts").orderBy("key").first()
    assert archive.open(one["link"]).where("offset = 0").first()["key"] == one["key"]
    with pytest.raises(LookupError):
        archive.open("posts:zzzzzzzzzz")


def test_names_are_resolved_over_everyone(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    people = [(f"p{i}", f"Ann Leeson{i}", None, at) for i in range(8)] + [("x", "Ann Lee", None, at)]
    spark.createDataFrame(people, "id string, name string, relationship_context string, updated_at timestamp").write.parquet(f"{tmp_path}/people.parquet")
    archive = Archive(spark, str(tmp_path))
    archive.who = lambda name, limit=20: spark.createDataFrame([(f"p{i}", "Ann Leeson", 3) for i in range(5)], "id string, name string, rank int")
    assert archive.resolve("ann lee") == "x"
    with pytest.raises(AmbiguousPerson):
        archive.resolve("ann")


def test_pages_go_on_where_they_were_stopped(spark, tmp_path):
    folder, place = tmp_path / "in", str(tmp_path / "loop")
    part = lambda n: rows(spark, [(f"k{n}", f"{n}"), ("both", f"{n}")]).coalesce(1).write.mode("append").parquet(f"{folder}/posts.parquet")
    part(1)
    part(2)
    seen = []

    def stop(number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("stopped")

    stream = lambda: stream_table(spark, str(folder), "posts", files=1)
    with pytest.raises(Exception, match="stopped"):
        page_loop(stream(), spark, "key", "text", "t", place, stop)
    part(3)
    beats = []
    heart = listen(spark, beats.append)
    newest, cursors = page_loop(stream(), spark, "key", "text", "t", place, seen.append)
    spark.streams.removeListener(heart)
    assert sorted(seen)[:1] == [0] and seen.count(0) == 1
    assert {r["key"]: r["text"] for r in newest.collect()} == {"k1": "1", "k2": "2", "k3": "3", "both": "3"}
    assert {r["page"]: r["rows_read"] for r in cursors.collect()} == {0: 2, 1: 2, 2: 2}


def test_registry(spark, data):
    from pyspark.sql import functions as F

    from garner.sources.tables import MissingColumns, table

    r = Registry()
    read = lambda s, f: table(s, f, "tweets", "id", "created_at", "text").select(F.lit("posts").alias("source"), F.col("id").alias("key"), F.col("created_at").alias("at"), F.lit("").alias("who"), F.lit("").alias("title"), "text")
    r.add(Source("posts", {"tweets": ("id", "text")}, read))
    r.add(Source("photos", {"photos": ("id",)}, lambda s, f: table(s, f, "chats", "jid")))
    r.add(Source("short", {"chats": ("jid",)}, lambda s, f: table(s, f, "chats", "jid")))
    assert r.names() == ["posts", "photos", "short"] and r.records("posts", spark, data).columns == list(RECORD)
    usable = r.usable(spark, data)
    assert usable["posts"] == usable["short"] == "" and usable["photos"]
    with pytest.raises(MissingColumns):
        r.records("short", spark, data)
    for name in ("posts", "Bad", "1x", "a b"):
        with pytest.raises(ValueError):
            r.add(Source(name, {}, read))
    with pytest.raises(LookupError):
        r.records("none", spark, data)


def test_settings():
    got = parse_settings('folder = "~/data"\nlimit = 5\n[sources.Posts]\nenabled = false\n[sources.mails]\npath = "x"', home="/home/u")
    assert (got.folder, got.limit, got.enabled(), got.store) == ("/home/u/data", 5, ["mails"], None)
    for bad in ("", 'folder = " "', 'folder = "a"\nlimit = 0', 'folder = "a"\ncolour = 1'):
        with pytest.raises(ValueError):
            parse_settings(bad)


def test_identity_operators(spark):
    k = rows(spark, [("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "d"), ("h3", None), ("h1", "a")], "record string, value string")
    p = rows(spark, [("p1", "a"), ("p1", "b"), ("p2", "c"), ("p3", "d"), ("p4", None)], "record string, value string")
    assert [tuple(r) for r in identity.unique_match(k, p, ["value"], "record").collect()] == [("h1", "p1")]
    keys = [("a", "x", "home"), ("b", "x", "home"), ("c", "y", "home"), ("a", "x", "one"), ("b", "x", "two"), ("c", "y", "one"), ("d", "x", "den"), ("e", "x", "den"), ("e", "x", "own"), ("f", "y", "own")]
    t = rows(spark, keys, "record string, source string, value string")
    shared = identity.ambiguous_keys(t, ["value"], "source", "record")
    assert {r["value"] for r in shared.collect()} == {"home", "den"}
    got = {(r["value"], r["record"]): r["stays"] for r in identity.repaired_groups(t, shared, ["value"], "record").collect()}
    assert got == {("home", "a"): False, ("home", "b"): False, ("home", "c"): False, ("den", "d"): False, ("den", "e"): False}
    whole = rows(spark, [("a", "x", "home"), ("b", "x", "home"), ("a", "x", "own"), ("b", "y", "own"), ("b", "x", "z")], "record string, source string, value string")
    assert {r["stays"] for r in identity.repaired_groups(whole, identity.ambiguous_keys(whole, ["value"], "source", "record"), ["value"], "record").collect()} == {True}


def test_ingest_queues(spark):
    old, new = rows(spark, [("a", "1"), ("b", None), ("c", "3")]), rows(spark, [("a", "1"), ("b", None), ("c", "4"), ("d", None)])
    assert {tuple(r) for r in ingest.changed_since(old, new, "key", ["text"]).collect()} == {("c", "changed"), ("d", "new")}
    assert {tuple(r) for r in ingest.refresh_or_insert(old, new, "key", True).collect()} == {tuple(r) for r in new.collect()}
    assert {tuple(r) for r in ingest.refresh_or_insert(old, new, "key", False).collect()} == {("a", "1"), ("b", None), ("c", "3"), ("d", None)}
    asked = rows(spark, [("g", f"i{n}", n // 2) for n in range(200)] + [("g", "i0", 5), ("h", "z", 1)], "grp string, item string, at int")
    got = ingest.capped_claims(asked, ["grp"], "item", "at", 3).collect()
    assert sorted((r["grp"], r["item"], r["claim"]) for r in got) == [("g", "i0", 1), ("g", "i1", 2), ("g", "i2", 3), ("h", "z", 1)]
    assert ingest.capped_claims(asked.where("false"), ["grp"], "item", "at", 3).count() == 0


def test_event_starts_are_read_in_every_form(spark, data):
    from garner.functions.instants import with_utc_ms
    from garner.plans.records import NOW_S, open_events
    from garner.plans.summaries import event_order
    from garner.sources.tables import table

    e = with_utc_ms(table(spark, data, "calendar_events", "event_uid", "start_time", "start_tz"), "start_time", "start_tz", "ms").where("ms is not null").collect()
    assert {r["event_uid"] for r in event_order(spark, data).collect()} == {r["event_uid"] for r in e}
    assert {r["event_uid"] for r in open_events(spark, data).collect()} == {r["event_uid"] for r in e if r["ms"] // 1000 >= NOW_S}
