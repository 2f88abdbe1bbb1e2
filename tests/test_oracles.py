"""Every SQL-checked query equals its DuckDB twin (rows, columns, types, values)."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["status"] == "OK", r
    assert "types" not in r, r


def test_every_query_has_an_oracle_or_is_rows_only():
    from quire.plans.registry import QUERIES as HERE
    from quire.plans.registry import ROWS_ONLY

    missing = set(HERE) - set(ORACLES) - ROWS_ONLY
    assert not missing, missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["rule_set", "model", "suite", "passed", "total", "score"]
