"""Corpus queries against their statements, at the smallest scale."""

import pytest
from comparing import difference, oracle_connection
from conftest import SMALL

from scriptledger.llm import queries


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, connection, name):
    assert difference(queries.QUERIES[name](spark, SMALL), connection, queries.SQL[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
