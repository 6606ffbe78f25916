"""Every graph query that has SQL gives DuckDB's rows and types on the smallest tables."""

import os

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=repr)
    assert got
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        types, order = dict(zip(rel.columns, map(str, rel.types), strict=True)), [rel.columns.index(c) for c in columns]
        assert {c: TYPES[t] for c, t in df.dtypes} == types
        assert got == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
