"""Every query of the core runs on the smallest data; those with SQL agree with it."""

import math
from pathlib import Path

import duckdb
import pytest

from tuffstone.plans import catalog


def plain(value):
    return ("nan" if math.isnan(value) else f"{value:.6g}") if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
