"""Every catalog query beside its SQL at the smallest scale."""

import pytest

import __spark_entry__ as spark_entry
from curbflow.plans import catalog, oracle
from tests.compare import connection, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_offers_them_all():
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees(spark, duck, name):
    assert difference(spark, duck, SF_DIR, name, QUERIES[name], ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0
