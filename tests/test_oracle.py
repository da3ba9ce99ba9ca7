"""Every registered query against its statement, at the smallest scale."""

import pytest
from comparing import difference, oracle_connection
from conftest import SMALL

import duckdb_statements
from scriptledger import registry

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


def test_every_query_has_a_statement():
    assert set(registry.QUERIES) == set(duckdb_statements.statements())
    assert set(entry.queries()) >= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, connection, name):
    frame = entry.queries()[name](spark, SMALL)
    assert difference(frame, connection, entry.oracle_sql()[name]) is None


def test_entry(spark, connection):
    frame = entry.entry(spark)
    statement = entry.oracle_sql()["payment_prescribing_correlation_min3"]
    assert difference(frame, connection, statement) is None
    assert frame.count() > 0
