"""Every registered query against DuckDB on the same tables; those without SQL must run and keep their schema."""

import math
import os

import duckdb
import pytest

from pagecask import catalog

TABLES = "documents pages contents snippets visit_items removals".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_flagship(spark, data):
    assert catalog.flagship(spark, data).columns[:2] == ["kind", "id"]


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
