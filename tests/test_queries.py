"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from perilgrid.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
