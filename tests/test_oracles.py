"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cadenza.plans import catalog
from cadenza.session import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x) if isinstance(x, (str, bool)) else x or 0) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) < 2e-6)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["boundary_peaks", "pca_scores"])
def test_queries_without_sql_return_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
