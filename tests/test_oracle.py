"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest
from compare import both, connect

import suite

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, con, name):
    if name not in suite.ORACLE:
        assert suite.QUERIES[name](spark, SF_DIR).count() >= 0
        return
    _, _, problems = both(spark, con, suite.QUERIES[name], suite.ORACLE[name], SF_DIR)
    assert not problems, problems


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
