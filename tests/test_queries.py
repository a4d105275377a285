"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.sqlcheck import compare, connect

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry_is_complete():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in STATEMENTS:
        problem = compare(con, frame, STATEMENTS[name])
        assert problem in (None, "EMPTY"), problem
    else:
        frame.count()


def test_entry(spark):
    assert entry.entry(spark).count() == 15
