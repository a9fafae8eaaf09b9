"""Every registered query gives rows and equals its SQL twin."""

import os

import pytest

import __spark_entry__ as contract
from oracle import compare, duck
from siftline.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows, problem = compare(frame, con, ORACLES[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_contract_holds_all_queries():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())
