"""Every registered query against its SQL, on the smallest tables; those without SQL have tests of their own."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences
from tallystone.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose result over these tables is rightly empty or one row.
SHORT = {"metrics_summary", "gate_verdict", "highest_bump", "two_set_overlap"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    mine, theirs, rows = differences(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert not mine and not theirs, (mine, theirs)
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule_id", "severity", "path", "lines", "message"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
