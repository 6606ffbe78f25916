"""The word-embedding trainer as a stage of pyspark.ml pipelines.

`WordEmbedding` learns from an array<string> column; its model gives each row the mean of its tokens' vectors. Unknown tokens
count in the mean as zero; a null or empty array has the zero vector; rows repeat as they come.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml import Model as Fitted
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasMaxIter, HasOutputCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from . import word2vec


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Settings(HasInputCol, HasOutputCol, HasSeed, HasMaxIter, HasStepSize):
    vectorSize = _param("vectorSize", "numbers in a vector", TypeConverters.toInt)
    numPartitions = _param("numPartitions", "parts of the corpus that are trained apart and averaged", TypeConverters.toInt)
    windowSize = _param("windowSize", "words on each side of a word, at most", TypeConverters.toInt)
    minCount = _param("minCount", "times that a word must occur to be learned", TypeConverters.toInt)
    maxSentenceLength = _param("maxSentenceLength", "words after which a sentence is cut", TypeConverters.toInt)
    cbow = _param("cbow", "whether the context predicts the word", TypeConverters.toBoolean)
    sample = _param("sample", "subsampling threshold, 0 for none", TypeConverters.toFloat)
    hs = _param("hs", "whether the softmax is hierarchical", TypeConverters.toBoolean)
    negative = _param("negative", "negative draws a word", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(outputCol=f"{self.uid}__output", seed=42, maxIter=1, stepSize=0.025, vectorSize=100, numPartitions=1, windowSize=5, minCount=5, maxSentenceLength=1000, cbow=False, sample=0.0, hs=True, negative=0)

    def checked(self, schema: StructType) -> None:
        column = self.getInputCol()
        kind = schema[column].dataType
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StringType):
            raise TypeError(f"{column} must be array<string>, not {kind.simpleString()}")
        if self.getOutputCol() in schema.names:
            raise ValueError(f"{self.getOutputCol()} is there already")


class WordEmbedding(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, seed: int = 42, maxIter: int = 1, stepSize: float = 0.025, vectorSize: int = 100, numPartitions: int = 1, windowSize: int = 5, minCount: int = 5, maxSentenceLength: int = 1000, cbow: bool = False, sample: float = 0.0, hs: bool = True, negative: int = 0):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs) -> WordEmbedding:
        return self._set(**kwargs)

    def config(self) -> word2vec.Config:
        """The trainer's settings; values out of range raise here."""
        get = self.getOrDefault
        return word2vec.Config(
            vector_size=get("vectorSize"), learning_rate=get("stepSize"), partitions=get("numPartitions"), iterations=get("maxIter"), seed=get("seed"), window=get("windowSize"),
            min_count=get("minCount"), max_sentence=get("maxSentenceLength"), cbow=get("cbow"), sample=get("sample"), hs=get("hs"), negative=get("negative"),
        )

    def _fit(self, dataset: DataFrame) -> WordEmbeddingModel:
        self.checked(dataset.schema)
        return self._copyValues(WordEmbeddingModel(word2vec.fit(dataset.select(F.col(self.getInputCol()).alias("tokens")), self.config())))


class _Writer(MLWriter):
    def __init__(self, instance: WordEmbeddingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.inner.save(f"{path}/model")


class _Reader(MLReader):
    def load(self, path: str) -> WordEmbeddingModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = WordEmbeddingModel(word2vec.Model.load(self.sparkSession, f"{path}/model"))
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model


class WordEmbeddingModel(Fitted, _Settings, MLReadable, MLWritable):
    def __init__(self, inner: word2vec.Model):
        super().__init__()
        self.inner = inner

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def getVectors(self) -> DataFrame:
        return self.inner.vectors

    def findSynonyms(self, word: str | list[float], num: int) -> DataFrame:
        return self.inner.find_synonyms(word, num)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Lists that occur several times are averaged once; the join is by a hash of the list, which recomputing can't change."""
        self.checked(dataset.schema)
        tokens, out = self.getInputCol(), self.getOutputCol()
        key, found = f"{self.uid}_key", f"{self.uid}_found"
        keyed = dataset.withColumn(key, F.sha2(F.to_json(F.col(tokens)), 256))
        lists = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(tokens).alias("tokens"))
        means = word2vec.document_vectors(lists, self.inner.vectors, self.inner.vector_size, key, "tokens").select(F.col(key).alias(found), F.col("vector").alias(out))
        zero = F.array_repeat(F.lit(0.0), self.inner.vector_size)
        return keyed.join(means, F.col(key) == F.col(found), "left").withColumn(out, array_to_vector(F.coalesce(F.col(out), zero))).drop(key, found)
