"""Queries over chroma against DuckDB where frames have no positive part."""

import os

import duckdb
import pytest

from cadenza.plans import catalog
from cadenza.session import TABLES
from tests.test_oracles import FOLDER

NAMES = [n for n, sql in sorted(catalog.oracle_sql().items()) if "frames as (select track, frame, pc, p / sqrt" in sql]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables; of five frames the first 12 dimensions are not positive."""
    folder, con = str(tmp_path_factory.mktemp("zero")), duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if name == "embeddings":
            low = "list_concat(list_transform(embedding[1:12], lambda x: -abs(x)), embedding[13:])"
            con.execute(f"copy (select vec_id, case when vec_id in (7, 123, 124, 301, 499) then {low} else embedding end as embedding, label from '{FOLDER}/{name}.parquet') to '{path}'")
        else:
            os.symlink(f"{FOLDER}/{name}.parquet", path)
        con.execute(f"create view {name} as select * from '{path}'")
    return folder, con


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and (abs(x - y) < 2e-6 or (x != x and y != y)))


@pytest.mark.parametrize("name", NAMES)
def test_zero_frames_equal_sql(spark, tables, name):
    folder, con = tables
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    keys = [c for c in columns if c in names and dict(df.dtypes)[c] != "double"]
    order = [columns.index(c) for c in keys + [c for c in columns if c not in keys]]

    def rows(raw):
        return sorted(raw, key=lambda r: tuple((r[i] is None, str(r[i]) if isinstance(r[i], (str, bool)) else float("inf") if r[i] != r[i] else r[i] or 0) for i in order))

    found = rows([tuple(r[c] for c in columns) for r in df.collect()])
    wanted = rows([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert len(found) == len(wanted) > 0
    assert [(a, b) for a, b in zip(found, wanted, strict=True) if not all(map(same, a, b))] == []


def test_boundary_peaks_with_zero_frames(spark, tables):
    assert catalog.queries()["boundary_peaks"](spark, tables[0]).count() > 0
