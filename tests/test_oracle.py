"""Every registered query against its DuckDB twin on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import canon_rows, duck

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_registry_consistent():
    qs = entry.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 60


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["name", "value"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.sql(ORACLE[name]).df()
    c1, r1 = canon_rows(sp)
    c2, r2 = canon_rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
