"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

# Long-running without SQL to compare; covered on small fixtures elsewhere.
SLOW = {"entity_resolution", "lexicon_fuzzy"}


@pytest.fixture(scope="module")
def oracle(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in SLOW])
def test_query_matches_sql(name, spark, sf, oracle):
    frame = contract.queries()[name](spark, sf)
    got = rows_of(frame.columns, frame.collect())
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        cursor = oracle.execute(sql)
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["uid", "title", "similarity", "percent"]


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
