import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Matrices, Vectors

from lattica.functions import local
from lattica.operators.estimator import WordEmbedding, WordEmbeddingModel
from lattica.plans.timing import Stopwatch

ROWS = [(1, "a b c a".split()), (1, "a b c a".split()), (2, "b c d".split()), (3, []), (4, None), (5, ["zz", "a"]), (6, [None, "a"])]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "word long, words array<string>").repartition(2)


@pytest.fixture(scope="module")
def model(corpus):
    return WordEmbedding(inputCol="words", outputCol="vec", vectorSize=4, minCount=2, windowSize=2, maxIter=2, stepSize=0.1, numPartitions=2).fit(corpus)


def test_means_of_tokens(corpus, model):
    known = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    assert set(known) == {"a", "b", "c"}
    rows = model.transform(corpus).collect()
    assert sorted(r.word for r in rows) == [1, 1, 2, 3, 4, 5, 6] and rows[0].asDict().keys() == {"word", "words", "vec"}
    for r in rows:
        want = sum((known.get(w, np.zeros(4)) for w in r.words or []), np.zeros(4)) / max(len(r.words or []), 1)
        assert r.vec.toArray() == pytest.approx(want, abs=1e-6)


def test_empty_table(spark, model):
    assert model.transform(spark.createDataFrame([], "words array<string>")).collect() == []


def test_settings_and_schema(spark, corpus):
    e = WordEmbedding(inputCol="words", minCount=1)
    assert e.copy({e.vectorSize: 7}).config().vector_size == 7 and e.setParams(hs=False, negative=3).config().negative == 3
    with pytest.raises(ValueError):
        WordEmbedding(inputCol="words", hs=False).fit(corpus)
    with pytest.raises(TypeError):
        WordEmbedding(inputCol="word").fit(corpus)
    with pytest.raises(ValueError):
        WordEmbedding(inputCol="words", outputCol="word").fit(corpus)


def test_saved_and_read(tmp_path, corpus, model):
    model.save(str(tmp_path / "m"))
    again = WordEmbeddingModel.load(str(tmp_path / "m"))
    assert again.uid == model.uid and again.getOutputCol() == "vec"
    assert sorted(map(str, again.transform(corpus).collect())) == sorted(map(str, model.transform(corpus).collect()))
    assert [r.word for r in again.findSynonyms("a", 1).collect()] == ["a"]
    e = WordEmbedding(inputCol="words", vectorSize=9)
    e.save(str(tmp_path / "e"))
    assert WordEmbedding.load(str(tmp_path / "e")).config() == e.config()


def test_in_a_pipeline(tmp_path, corpus, model):
    whole = PipelineModel([model])
    whole.save(str(tmp_path / "p"))
    assert PipelineModel.load(str(tmp_path / "p")).transform(corpus).count() == len(ROWS)
    assert Pipeline(stages=[WordEmbedding(inputCol="words", vectorSize=2, minCount=1)]).fit(corpus).transform(corpus).count() == len(ROWS)


def test_stopwatch(tmp_path, capsys):
    w = Stopwatch()
    assert w.mark("first").millis >= 0 and "test_estimator.py:" in w.mark("second").where
    w.show()
    w.save(str(tmp_path / "t"))
    assert capsys.readouterr().out == (tmp_path / "t").read_text() and [m.message for m in w.marks] == ["first", "second"]


def test_local_updates():
    dense, sparse = Matrices.dense(2, 2, [1, 2, 3, 4]), local.from_coo(2, 3, [(0, 1, 5.0), (1, 2, 6.0)])
    assert local.updated(dense, 0, 1, 9.0).toArray().tolist() == [[1, 9], [2, 4]] and dense.toArray()[0, 1] == 3
    assert local.updated(sparse, 1, 2, 0.0).toArray().tolist() == [[0, 5, 0], [0, 0, 0]]
    assert local.count_active(local.updated(sparse, 1, 2, 0.0)) == 2 and local.count_active(local.updated(sparse, 1, 2, 0.0), nonzero=True) == 1
    assert local.count_active(Vectors.sparse(5, [1], [0.0])) == 1 and local.count_active(Vectors.dense(0, 2), nonzero=True) == 1
    for bad, kind in (((0, 0), KeyError), ((2, 0), IndexError)):
        with pytest.raises(kind):
            local.updated(sparse, *bad, 1.0)
