import math

import duckdb
import pytest

from pagemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    return con


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_agrees_with_its_oracle(spark, db, name):
    df = queries.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        return
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(norm(v) for v in r) for r in rows), key=repr) == want
