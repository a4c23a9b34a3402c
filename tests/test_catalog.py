import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from pagemill import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = db.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in df.columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(v) for v in r) for r in rows), key=repr)
    assert got == want


def test_entry_module(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).limit(1).count() == 1
