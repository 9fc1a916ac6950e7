"""Every registered query against its SQL on small tables."""

import decimal
import math

import duckdb
import pytest

from provenant import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    want = db.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    where = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr)
    b = sorted((tuple(plain(r[i]) for i in where) for r in want.fetchall()), key=repr)
    assert a == b
