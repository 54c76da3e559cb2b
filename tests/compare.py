"""Spark results against DuckDB's on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def views(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    return value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def rows_of_sql(con, sql):
    got = con.sql(sql)
    at = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in at], sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
