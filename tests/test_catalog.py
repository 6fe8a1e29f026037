"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import os

import duckdb
import pytest

from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "as_tuple"):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in catalog.oracle_sql():
        result = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert got == ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
