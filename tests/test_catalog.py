"""Every query with a DuckDB twin gives its rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewheel import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted((tuple(r) for r in frame.select(columns).collect()), key=repr)
    if name not in catalog.ORACLE:
        assert mine
        return
    found = tables.sql(catalog.ORACLE[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert mine == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
