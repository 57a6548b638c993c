"""Every query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from oracle.queries import ORACLES
from tests.compare import connect, first_difference, oracle_rows, spark_rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(contract.LIBRARY) == set(ORACLES)


@pytest.mark.parametrize("name", list(contract.LIBRARY))
def test_query_matches_oracle(spark, con, name):
    names, rows = spark_rows(contract.queries()[name](spark, SF_DIR))
    expected_names, expected = oracle_rows(con, contract.oracle_sql()[name])
    assert names == expected_names
    assert rows, "an empty result proves nothing"
    assert first_difference(rows, expected) is None


def test_entry_has_one_row_per_fund(spark):
    assert contract.entry(spark).count() == 4
