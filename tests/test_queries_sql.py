"""Every core query with SQL gives DuckDB's rows over the smallest tables, and has rows."""

from __future__ import annotations

import pytest

import oracle
from palimpsest.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert oracle.compare(df, queries.ORACLES[name], con) == ""


def test_query_full_has_ranked_rows(spark):
    rows = queries.QUERIES["query_full"](spark, SF).collect()
    assert rows
    by: dict = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= queries.K for x in by.values())
