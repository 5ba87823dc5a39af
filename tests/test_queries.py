"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from worktally.catalog.oracles import ORACLES
from worktally.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Results that are rightly empty on the smallest tables.
MAY_BE_EMPTY = {"quality_rejects", "get_dupes_all_columns", "get_dupes_lineitem", "single_value_report"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert verdict == "" or (verdict == "EMPTY RESULT" and name in MAY_BE_EMPTY)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
