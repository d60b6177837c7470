"""Every query with SQL against DuckDB on the smallest tables, where these are."""

import decimal
import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    found = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(k)]) for k in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[k]) for k in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
