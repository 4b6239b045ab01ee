"""Every registered query against its SQL, on the driver's tables."""

import os

import pytest

import oracle
from millrace.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert oracle.compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).columns == ["n_name", "revenue", "n_lines"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
