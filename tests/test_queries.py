"""Every reference query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarrymill.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
