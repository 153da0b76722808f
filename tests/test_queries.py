"""Every registered query runs on the smallest tables and agrees with its oracle SQL."""

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"layer_recurrence", "search_amount"}
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(QUERIES) - len(ORACLES) <= 4


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["owner_id", "fy_key"] and not frame.isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None or (name in MAY_BE_EMPTY and problem.startswith("EMPTY")), problem
