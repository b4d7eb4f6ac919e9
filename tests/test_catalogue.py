"""Queries with SQL give the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark conversations pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _rows(rows):
    return sorted(tuple(repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.sql(catalogue.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert _rows(tuple(r[c] for c in cols) for r in df.collect()) == _rows(tuple(r[i] for i in at) for r in rel.fetchall())
