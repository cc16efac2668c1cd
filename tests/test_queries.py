"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from mootlake.plans import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], CHECKS[name])
    assert ok, message
