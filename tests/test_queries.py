"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from rastrum.plans import catalog

SF = "/root/testdata/sf0.001"


def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as from '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    want = tables().sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
