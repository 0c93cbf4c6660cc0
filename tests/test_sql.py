"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from lucerna.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tables, duck, name):
    df = catalog.QUERIES[name](spark, tables)
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    at = [want.columns.index(c) for c in names]
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, tables, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0
