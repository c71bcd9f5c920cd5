"""Every bound query against its SQL oracle."""

from __future__ import annotations

import os

import pytest

from listflow.suite import ORACLES, QUERIES
from listflow.suite.check import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith("ok") or result == "no rows on either side", result


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
