"""Instants against Python's own calendar and zone rules."""

import datetime as dt
import zoneinfo

from garner.functions.instants import with_utc_ms


def ms(*args, zone="UTC", fold=0):
    return int(dt.datetime(*args, tzinfo=zoneinfo.ZoneInfo(zone), fold=fold).timestamp() * 1000)


CASES = [
    ("2024-05-01T10:15:00+02:00", None, ms(2024, 5, 1, 8, 15)),
    ("2024-05-01 10:15:00.1239-0530", "Asia/Tokyo", ms(2024, 5, 1, 15, 45) + 123),
    ("2024-05-01 10:15", "Europe/Berlin", ms(2024, 5, 1, 10, 15, zone="Europe/Berlin")),
    ("2024-05-01 10:15", None, None),
    ("2024-05-01 10:15", "  ", None),
    ("2024-05-01 10:15", "Mars/Olympus", None),
    ("2024-05-01", "America/New_York", ms(2024, 5, 1, zone="America/New_York")),
    ("20240501", "UTC", ms(2024, 5, 1)),
    ("20240501T101500Z", None, ms(2024, 5, 1, 10, 15)),
    ("TZID=Europe/Madrid:20240501T101500", None, ms(2024, 5, 1, 10, 15, zone="Europe/Madrid")),
    ("01.05.2024 10:15", "UTC", ms(2024, 5, 1, 10, 15)),
    ("5/1/2024 12:05 AM", "UTC", ms(2024, 5, 1, 0, 5)),
    ("5/1/2024 12:05 pm", "UTC", ms(2024, 5, 1, 12, 5)),
    ("13/1/2024 12:05 PM", "UTC", None),
    ("Wed, 1 May 2024 10:15:00 CEST", None, ms(2024, 5, 1, 8, 15)),
    ("Wed May 01 10:15:00 +0200 2024", None, ms(2024, 5, 1, 8, 15)),
    ("1. März 2024 um 10:15", "UTC", ms(2024, 3, 1, 10, 15)),
    ("1 août 2024 à 10:15", "UTC", ms(2024, 8, 1, 10, 15)),
    ("March 3, 2024 at 1:02:03 PM", "UTC", ms(2024, 3, 3, 13, 2, 3)),
    ("2024-05-01T10:15:00[Europe/Berlin]", None, ms(2024, 5, 1, 8, 15)),
    ("2024-05-01 01:15:00 America/New_York", None, ms(2024, 5, 1, 5, 15)),
    ("2024-10-27 02:30", "Europe/Berlin", ms(2024, 10, 27, 0, 30)),  # occurs twice: the first
    ("2024-03-31 02:30", "Europe/Berlin", ms(2024, 3, 31, 1, 30)),  # never occurs: on by the gap
    ("2024-02-30", "UTC", None),
    ("2023-02-29", "UTC", None),
    ("2024-05-01 24:00", "UTC", None),
    ("0001-01-01 00:00:00", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("1714558500", None, 1714558500000),
    ("1714558500.9999", None, 1714558500999),
    ("1.7145585E9", None, 1714558500000),
    ("1714558500123", None, 1714558500123),
    ("1714558500123456", None, 1714558500123),
    ("1714558500123456789", None, 1714558500123),
    ("736251300", None, 1714558500000),
    ("736251300123456789", None, 1714558500123),
    ("0", None, None),
    ("-1", None, None),
    ("99999999999999999999999999999999999999999", None, None),
    ("unknown", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 100_000, "UTC", None),
]


def test_instants(spark):
    rows = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r["i"]: r["ms"] for r in with_utc_ms(rows, "v", "z", "ms").collect()}
    assert {(CASES[i][0] or "")[:60]: got[i] for i in got if got[i] != CASES[i][2]} == {}


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([("2024-05-01", "UTC", "kept", "also", 7)], "v string, z string, __own string, `a.b` string, ms int")
    assert with_utc_ms(rows, "v", "z", "ms").collect() == [("2024-05-01", "UTC", "kept", "also", ms(2024, 5, 1))]
    assert with_utc_ms(spark.createDataFrame([], "v string, z string"), "v", "z").count() == 0
