"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests import oracle
from workload import registry

SQL = registry.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert frame.count() >= 0
        return
    ok, note = oracle.compare(frame, duck, SQL[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
