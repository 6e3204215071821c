"""Every registered query against its SQL twin on the small tables."""

import pytest

import compare
from __spark_entry__ import entry
from pagelens.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    said = compare.differs(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert said is None, said


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
