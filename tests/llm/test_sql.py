"""Queries of the training-data operators that SQL can express give DuckDB's rows and types, on the driver's tables and on odd rows."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lattica.llm import suffix_dedup
from lattica.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
PASSAGE = "a passage of well over fifty bytes that some texts share, é and all. "
TEXTS = [None, "", " \n\x0b", PASSAGE, f"one {PASSAGE}two", f"{PASSAGE}{PASSAGE}", "LOUD " * 40, "a|b " * 30, "line\nline\n\nline two.", "w " * 9, "Straße ÉTÉ ½ 中文 \x1c\x85"]


def compare(spark, name, where):
    duck = duckdb.connect()
    for f in os.listdir(where):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{where}/{f}'")
    df, rel = QUERIES[name](spark, where), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    types, order = dict(zip(rel.columns, map(str, rel.types), strict=True)), [rel.columns.index(c) for c in columns]
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_on_tables(spark, name):
    compare(spark, name, DATA)


@pytest.mark.parametrize("rows", [0, None])
def test_on_odd_rows(spark, tmp_path, rows):
    g = np.random.default_rng(1)
    vectors = [x.astype("f4").tolist() for x in g.standard_normal((30, 64))]
    vectors += [(np.array(v) * 3 + 1e-3).astype("f4").tolist() for v in vectors[:9]] + [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, vectors[0], vectors[0]]
    vec = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    doc = pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())})
    for name, t in (("documents", doc), ("embeddings", vec)):
        pq.write_table(t.slice(0, rows), f"{tmp_path}/{name}.parquet")
    for name in ("op7_suffix_dedup", "op8_quality_rules", "rule_ablations", "op9_embedding_dedup"):
        compare(spark, name, str(tmp_path))


@pytest.mark.parametrize("bits", [8, 40, 62, 64])
def test_sorted_keys_where_a_word_holds_the_place_and_where_not(bits):
    g = np.random.default_rng(bits)
    key = g.integers(0, 1 << bits, 5000, dtype="u8")
    key[::3] = key[0]
    got, order = suffix_dedup.sorted_keys(key, bits)
    assert (order == np.argsort(key, kind="stable")).all() and (got == np.sort(key)).all()
    assert (suffix_dedup.ranks(key, bits) == np.unique(key, return_inverse=True)[1]).all()
