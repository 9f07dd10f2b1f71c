"""Every registered query with SQL against DuckDB over small tables."""

import math
import os

import duckdb
import pytest

from plumbline import catalog

DATA = "/root/testdata/sf0.01"  # claim ids are not unique in the smallest tables
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, DATA).count() > 0
