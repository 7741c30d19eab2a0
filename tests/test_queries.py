"""Every registered query beside its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from decklake.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "quantize"):
        x = float(value)
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
