import os

import pytest

from lattica.llm import common

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages_one_by_one(spark):
    """Each stage against what it promises on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    before = text(docs)
    for name, stage in pipeline.STAGES:
        out = common.staged(stage(spark, docs, DATA))
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(before)
            break
        assert out.dtypes == docs.dtypes
        after = text(out)
        if name == "quality":
            gone = set(before) - set(after)
            assert {labels.get(i, 0) for i in gone} == {0} and sum(labels.get(i) == 0 for i in after) <= 2
        elif name == "near_copies":
            assert len(set(after.values())) == len(after) and set(after) <= set(before)
        elif name == "repeated_passages":
            assert set(after) == set(before) and sum(map(len, after.values())) < sum(map(len, before.values()))
        else:
            assert set(after) == set(before)
        docs, before = out, after


def test_stages_on_odd_rows(spark):
    rows = [(1, "one " * 40, "en", "s", None), (1, "one " * 40, "en", "s", None), (None, "two words", None, None, 9), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "token=abcdefghijklmnop", "en", "s", 22)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, kind)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs, DATA).count() > 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert sorted(r.doc_id or 0 for r in pipeline.near_copies(spark, docs, DATA).collect()) == [0, 1, 3, 5]
    cleaned = {r.doc_id: (r.text, r.n_chars) for r in pipeline.secrets(spark, docs, DATA).collect()}
    assert cleaned[5] == ("[assign]", 8) and cleaned[3] == ("", 0)
    assert pipeline.quality(spark, docs, DATA).count() <= len(rows)


def test_repeated_ids_and_clashing_columns(spark):
    """An exact copy under an id that another text has goes; extra columns of any name come through."""
    a, b = " ".join(f"one{k}" for k in range(50)) + ".", " ".join(f"two{k}" for k in range(50)) + "."
    extra = "id string, row int, txt int, cls bigint, fp bigint, keys int, x double, gone boolean, component bigint, low int, kept int, shard int, c_0 int"
    rows = [(*r, "en", "s", 0, *("k", *(None,) * 12)) for r in ((1, a), (3, b), (3, a))]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    assert sorted((r.doc_id, r.text, r.id) for r in pipeline.near_copies(spark, docs, DATA).collect()) == [(1, a, "k"), (3, b, "k")]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes and {r.id for r in out.collect()} <= {"k"}, name


def test_near_copies_by_content(spark):
    """Copies with some words in a hundred changed go; a text that shares less stays."""
    words = [f"word{k * k % 997}" for k in range(240)]
    changed = lambda step: " ".join("other" if k % step == 7 else w for k, w in enumerate(words))
    rows = [(1, " ".join(words), "en", "s", 0), (2, changed(50), "en", "s", 0), (3, changed(12), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, DATA).collect()) == [1, 3]


def test_run(spark):
    got = pipeline.run(spark, DATA)
    assert got.count() > 0 and got.selectExpr("max(offset + length)").head()[0] <= 2048
