"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest
from oracle import compare, duck

from palimpsest.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], con) == ""
