"""Every registered job against its DuckDB oracle (tools/oracle_check.py rules)."""

import pytest

from support import SF_SMALL
from tessera.plans import ORACLE, QUERIES

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_job_matches_oracle(spark, con, name):
    from tools.oracle_check import compare
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_job_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 31
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
