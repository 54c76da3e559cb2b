"""Every query that has SQL gives the same rows as DuckDB; every other one gives rows of a stable schema."""

import pytest
from compare import rows_of, rows_of_sql, views

import __spark_entry__ as entry
from garner.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, data, con, name):
    assert rows_of(catalog.QUERIES[name](spark, data)) == rows_of_sql(con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_columns_are_named(spark, data):
    from garner.sources.tables import MissingColumns, table

    with pytest.raises(MissingColumns, match="chats lacks nowhere"):
        table(spark, data, "chats", "nowhere")
