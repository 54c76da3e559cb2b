"""The archive's operations on the smallest tables."""

import datetime as dt

import pytest

from garner.api import AmbiguousPerson, Archive, UnknownPerson, parse_date


@pytest.fixture(scope="module")
def archive(spark, data):
    return Archive(spark, data)


def test_dates():
    at = lambda *a: dt.datetime(*a, tzinfo=dt.UTC)
    assert parse_date("2024-05-01") == at(2024, 5, 1)
    assert parse_date(" 2024-05-01 ", end=True) == at(2024, 5, 1, 23, 59, 59, 999999)
    assert parse_date("2024-05-01 10:15", end=True) == at(2024, 5, 1, 10, 15, 59, 999999)
    assert parse_date("2024-05-01T10:15:00+02:00", end=True) == at(2024, 5, 1, 8, 15)
    for bad in ("", "May 1", "2024-13-01", "2024-05-01T10:15:00"):
        with pytest.raises(ValueError):
            parse_date(bad)


def test_search(archive):
    rows = archive.search("the", limit=15).collect()
    assert 0 < len(rows) <= 15
    times = [r["at"] for r in rows if r["at"]]
    assert times == sorted(times, reverse=True)
    assert all(r["title"] or any(x["matched"] for x in r["text"]) for r in rows)
    assert archive.search("", after="2024-01-01", before="2024-12-31", sources=("posts",)).where("at < timestamp'2024-01-01' or at >= timestamp'2025-01-01'").count() == 0
    assert archive.search("zzzz-nothing").count() == 0
    for bad in ({}, {"words": "a", "limit": 0}, {"words": "a", "after": "2025-01-01", "before": "2024-01-01"}):
        with pytest.raises(ValueError):
            archive.search(**bad)


def test_people(archive):
    name = archive.people(limit=1).first()["name"]
    assert archive.who(name).first()["rank"] == 4
    with pytest.raises(UnknownPerson):
        archive.resolve("Qqqqqq Xxxxxx")
    with pytest.raises(AmbiguousPerson):
        archive.resolve("a")
    assert archive.people("zzzzzz").count() == 0


def test_conversations_and_links(archive):
    top = archive.conversations(limit=5).collect()
    assert len(top) == 5 and archive.conversations(unread=True).count() <= 50
    biggest = max((r for r in archive.conversations(limit=None).where("source = 'chats'").collect()), key=lambda r: r["messages"])
    got = archive.messages("chats", biggest["conversation"], 3).collect()
    assert len(got) == 3 and got[0]["total"] == biggest["messages"]
    link = archive.links("chats").where(f"key = '{got[0]['key']}'").first()["link"]
    opened = archive.open(link, 2).collect()
    assert [r["key"] for r in opened if r["offset"] == 0] == [got[0]["key"]] and len(opened) <= 5
    with pytest.raises(LookupError):
        archive.open("chats:zzzzzzzz")
    with pytest.raises(ValueError):
        archive.records("nowhere")


def test_notes_posts_and_status(archive):
    assert {r["source"] for r in archive.status().collect()} == {"chats", "mails", "posts", "notes", "calendar"}
    note = archive.records("notes").first()["key"]
    assert archive.note_versions(note).count() >= archive.note_versions(note, "2100-01-01").count() == 1
    stats = archive.post_stats("2026-12-31", days=4000, limit=3).collect()
    assert [r["like_count"] for r in stats] == sorted((r["like_count"] for r in stats), reverse=True)
    with pytest.raises(ValueError):
        archive.post_stats("2026-12-31", by="text")
