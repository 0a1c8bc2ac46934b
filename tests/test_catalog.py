"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checker import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = ORACLES.get(name)
    message, _, _ = compare(spark, con, SF, name, QUERIES[name], sql)
    assert message is None


@pytest.mark.parametrize("name", ["assign_class", "eb_update"])
def test_crashes_are_matched_once(spark, name):
    """Results start from matched crashes that were written, not from several copies of the matching's plan."""
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if "orders" in f]
