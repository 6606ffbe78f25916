"""Word embeddings: skip-gram and CBOW with hierarchical softmax, negative sampling and subsampling.

The vocabulary, the tree and the weights are shared with every task, so vocabulary x dimension is bounded and checked; the corpus
is not. Each iteration trains partitions apart and averages, in executors, the rows that any of them changed; the driver gets the
averages as packed batches. A window is one matrix step: all its words meet the target's outputs as they were before it, and their
gradients add up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import cosine, doubles
from ..plans.lineage import staged, with_row_index

#: Cells of one weight table at most; it is broadcast.
MAX_CELLS = 1 << 28


@dataclass
class Config:
    vector_size: int = 100
    learning_rate: float = 0.025
    partitions: int = 1
    iterations: int = 1
    seed: int = 42
    window: int = 5
    min_count: int = 5
    max_sentence: int = 1000
    cbow: bool = False
    sample: float = 0.0
    hs: bool = True
    negative: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.learning_rate <= 1 or not 0 <= self.sample <= 1:
            raise ValueError("learning_rate must be in (0, 1] and sample in [0, 1]")
        if min(self.vector_size, self.partitions, self.window, self.max_sentence) < 1 or min(self.iterations, self.min_count, self.negative) < 0:
            raise ValueError("sizes must be positive")
        if not self.hs and not self.negative:
            raise ValueError("either hs or negative sampling is needed")


def vocabulary(tokens: DataFrame, min_count: int) -> DataFrame:
    """(word, cn, idx): words of tokens(tokens array<string>) by descending count, then word, by a distributed index."""
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cn")).where(F.col("cn") >= min_count)
    return with_row_index(counts, F.desc("cn"), F.asc("word"), name="idx").select("word", "cn", "idx")


def huffman_paths(counts: np.ndarray) -> tuple[Ragged, Ragged]:
    """(codes, points) of descending counts: the path's bits and inner nodes from the root. A tie takes the older inner node."""
    n = len(counts)
    if n < 2:
        return tuple(Ragged(np.zeros(n, t), np.arange(n + 1)) for t in ("u1", "i4"))
    parent, weight, leaf, inner = [0] * (2 * n - 1), counts.tolist() + [0] * (n - 1), n - 1, n
    bit = np.zeros(2 * n - 1, "u1")
    # leaves ascend from the end of the list and inner nodes as they are made; an inner node wins a tie
    for k in range(n, 2 * n - 1):
        for right in (0, 1):
            if inner < k and (leaf < 0 or weight[inner] <= weight[leaf]):
                at, inner = inner, inner + 1
            else:
                at, leaf = leaf, leaf - 1
            parent[at] = k
            weight[k] += weight[at]
            bit[at] = right
    up, root, at, depth = np.array(parent), 2 * n - 2, np.arange(n), np.zeros(n, "i8")
    while (below := at != root).any():
        depth += below
        at = np.where(below, up[at], root)
    begin = np.append(0, np.cumsum(depth))
    codes, points = np.zeros(begin[-1], "u1"), np.zeros(begin[-1], "i4")
    word, at, to = np.arange(n), np.arange(n), begin[1:] - 1
    while len(word):
        codes[to], points[to] = bit[at], up[at] - n
        left = up[at] != root
        word, at, to = word[left], up[at][left], to[left] - 1
    return Ragged(codes, begin), Ragged(points, begin)


def huffman(counts: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """huffman_paths() as lists."""
    return tuple([x[k].tolist() for k in range(len(counts))] for x in huffman_paths(np.array(counts, "i8")))


def keep_probability(vocab: DataFrame, sample: float) -> DataFrame:
    """(word, keep): sqrt(cn / (sample T) + 1) * sample T / cn, T being the words in training."""
    total = vocab.agg(F.sum("cn").alias("total"))
    ratio = F.col("cn") / (F.lit(sample) * F.col("total"))
    return vocab.join(F.broadcast(total)).select("word", (F.sqrt(ratio + 1) / ratio).alias("keep"))


def unigram_probability(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(word, prob) of being drawn as a negative."""
    total = vocab.agg(F.sum(F.pow(F.col("cn").cast("double"), F.lit(power))).alias("total"))
    return vocab.join(F.broadcast(total)).select("word", (F.pow(F.col("cn").cast("double"), F.lit(power)) / F.col("total")).alias("prob"))


def sentence_chunks(tokens: DataFrame, vocab: DataFrame, size: int, id_col: str) -> DataFrame:
    """(id, chunk, n_words): known words of each sentence, cut into pieces of `size`."""
    known = tokens.select(id_col, F.posexplode("tokens").alias("pos", "word")).join(vocab.select("word"), "word", "left_semi")
    at = F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1
    return known.select(id_col, F.floor(at / F.lit(size)).cast("bigint").alias("chunk")).groupBy(id_col, "chunk").agg(F.count(F.lit(1)).alias("n_words"))


def rate(c: Config, seen: int, total: int) -> float:
    """The learning rate once a partition has seen so many of the total words: linear to zero, but for the last ten-thousandth."""
    return max(c.learning_rate * (1 - c.partitions * seen / (total + 1)), c.learning_rate * 1e-4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Ragged:
    """Lists of different lengths in one array; the k-th is between the k-th and the next of begin."""

    flat: np.ndarray
    begin: np.ndarray

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.begin[k] : self.begin[k + 1]]


@dataclass
class _Weights:
    syn0: np.ndarray
    syn1: np.ndarray
    syn1neg: np.ndarray
    touched: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.touched = [np.zeros(len(t), bool) for t in (self.syn0, self.syn1, self.syn1neg)]

    def learn(self, h: np.ndarray, c: Config, word: int, codes: Ragged | list, points: Ragged | list, draw, lr: float) -> np.ndarray:
        """Updates output rows for inputs h, one or a row each, and a target word; the gradient for each input."""
        x = np.atleast_2d(h)
        grad = np.zeros_like(x)
        if c.hs and len(points[word]):
            at, want = np.asarray(points[word]), 1 - np.asarray(codes[word], 'i4')
            out = self.syn1[at]
            f = x @ out.T
            g = np.where(np.abs(f) < 6, (want - _sigmoid(np.clip(f, -6, 6))) * lr, 0).astype("f4")
            grad += g @ out
            self.syn1[at] = out + g.T @ x
            self.touched[1][at] = True
        if c.negative:
            drawn = draw(c.negative)
            at = np.unique(np.append(drawn[drawn != word], word))
            out = self.syn1neg[at]
            f = x @ out.T
            f = np.where(f > 6, 1.0, np.where(f < -6, 0.0, _sigmoid(np.clip(f, -6, 6))))
            g = (((at == word) - f) * lr).astype("f4")
            grad += g @ out
            self.syn1neg[at] = out + g.T @ x
            self.touched[2][at] = True
        return grad.reshape(h.shape)


def _skip_gram_tree(s: np.ndarray, reaches: np.ndarray, w: _Weights, codes: Ragged, points: Ragged, lr: float) -> None:
    """learn() over the windows of one sentence, for inputs one by one and a tree alone, in as few calls as a window can have: the target's
    own row goes along with a gradient of zero, and the gradients of a word that a window has twice add up by a product."""
    n = len(s)
    if n < 2:
        return
    at = np.arange(n)
    low, high = np.maximum(at - reaches, 0), np.minimum(at + reaches + 1, n)
    order = np.argsort(s, kind="stable")
    again = np.full(n, n)
    same = s[order[1:]] == s[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    twice = np.minimum.accumulate(again[::-1])[::-1][low] < high  # a word that stands at low or behind it comes again before high
    begin, end = points.begin[s], points.begin[s + 1]
    syn0, syn1, half = w.syn0, w.syn1, np.float32(0.5)
    for i, lo, hi, a, b, several in zip(at.tolist(), low.tolist(), high.tolist(), begin.tolist(), end.tolist(), twice.tolist(), strict=True):
        near, path = s[lo:hi], points.flat[a:b]
        x, out = syn0.take(near, 0), syn1.take(path, 0)
        f = x.dot(out.T)
        g = np.tanh(f * half)
        g += codes.flat[a:b]  # codes as -1 and 1: the sigmoid is (1 + tanh(f / 2)) / 2
        g *= np.float32(-0.5 * lr)
        g *= np.abs(f) < 6
        g[i - lo] = 0
        grad = g.dot(out)
        syn1[path] = out + g.T.dot(x)
        syn0[near] = x + ((near[:, None] == near).astype("f4").dot(grad) if several else grad)
    size = end - begin
    w.touched[0][s] = True
    w.touched[1][points.flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True


def _train(sentences: Iterator[list[int] | np.ndarray], w: _Weights, c: Config, counts: np.ndarray, codes: Ragged, points: Ragged, rng: np.random.Generator) -> None:
    total = int(counts.sum())
    if c.hs and not c.negative and not c.cbow:
        codes = Ragged(2 * codes.flat.astype("i1") - 1, codes.begin)
    edges = np.cumsum(counts.astype(float) ** 0.75)
    draw = lambda n: np.searchsorted(edges, rng.random(n) * edges[-1], "right")
    ratio = counts / (c.sample * total) if c.sample else None
    seen = 0
    for s in sentences:
        seen += len(s)
        lr, s = rate(c, seen, total), np.array(s, "i4")
        if ratio is not None:
            s = s[np.sqrt(ratio[s] + 1) / ratio[s] >= rng.random(len(s))]
        reaches = c.window - rng.integers(c.window, size=len(s))
        if c.hs and not c.negative and not c.cbow:
            _skip_gram_tree(s, reaches, w, codes, points, lr)
            continue
        for i, (word, reach) in enumerate(zip(s.tolist(), reaches.tolist(), strict=True)):
            near = np.concatenate((s[max(0, i - reach) : i], s[i + 1 : i + 1 + reach]))
            if not len(near):
                continue
            x = w.syn0[near]
            grad = w.learn(x.sum(0) if c.cbow else x, c, word, codes, points, draw, lr)
            np.add.at(w.syn0, near, grad)
            w.touched[0][near] = True


@dataclass
class Model:
    """vectors(word, vector array<float>)."""

    vectors: DataFrame
    vector_size: int

    def transform(self, word: str) -> list[float]:
        found = self.vectors.where(F.col("word") == word).head()
        if found is None:
            raise KeyError(word)
        return list(found.vector)

    def find_synonyms(self, query: str | list[float], k: int, exclude_self: bool = False) -> DataFrame:
        """(word, similarity), most similar first; the query word is among them unless excluded."""
        vec = self.transform(query) if isinstance(query, str) else query
        rows = self.vectors.where(F.col("word") != query) if exclude_self and isinstance(query, str) else self.vectors
        return synonyms(rows, vec, k)

    def transform_documents(self, docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
        return document_vectors(docs, self.vectors, self.vector_size, id_col, tokens_col)

    def save(self, path: str, words: int | None = None) -> None:
        n = self.vectors.count() if words is None else words
        self.vectors.sparkSession.createDataFrame([(json.dumps({"class": "lattica.word2vec", "version": "1.0", "vectorSize": self.vector_size, "numWords": n}),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        self.vectors.repartition(max(1, (4 * self.vector_size + 15) * n >> 26)).write.parquet(f"{path}/data")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/metadata").head()[0])
        vectors = spark.read.parquet(f"{path}/data")
        if (meta["class"], meta["version"]) != ("lattica.word2vec", "1.0"):
            raise ValueError(f"not a model of this version: {meta}")
        if [(f.name, f.dataType.simpleString()) for f in vectors.schema] != [("word", "string"), ("vector", "array<float>")]:
            raise ValueError("unexpected schema")
        if vectors.count() != meta["numWords"] or vectors.where(F.size("vector") != meta["vectorSize"]).count():
            raise ValueError("words or sizes differ from the metadata")
        return cls(vectors, meta["vectorSize"])


def synonyms(vectors: DataFrame, vec: list[float], k: int) -> DataFrame:
    query = F.array(*(F.lit(float(x)) for x in vec))
    return vectors.select("word", cosine(doubles(F.col("vector")), query).alias("similarity")).orderBy(F.desc("similarity"), "word").limit(k)


def document_vectors(docs: DataFrame, vectors: DataFrame, size: int, id_col: str, tokens_col: str) -> DataFrame:
    """(id, vector): the mean over all tokens, unknown ones counting as zero; zeros for no tokens."""
    words = docs.select(id_col, F.explode(tokens_col).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    found = words.join(vectors, "word").select(id_col, F.col("n").cast("double").alias("n"), array_to_vector(doubles(F.col("vector"))).alias("x"))
    sums = found.groupBy(id_col).agg(vector_to_array(Summarizer.sum(F.col("x"), F.col("n"))).alias("s"))
    whole = F.coalesce("s", F.array_repeat(F.lit(0.0), size))
    return docs.join(sums, id_col, "left").select(id_col, F.transform(whole, lambda x: x / F.greatest(F.size(tokens_col), F.lit(1))).alias("vector"))


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype="i4"), rows.ravel())


def fit(tokens: DataFrame, c: Config) -> Model:
    """Trains on tokens(tokens array<string>)."""
    spark = tokens.sparkSession
    vocab = vocabulary(tokens, c.min_count).where(F.col("idx") <= MAX_CELLS // c.vector_size).orderBy("idx").select("word", "cn").toArrow()
    n, d = len(vocab), c.vector_size
    if not n:
        raise ValueError("the vocabulary is empty")
    if n * d > MAX_CELLS:
        raise ValueError("vocabulary x vector_size is too large to share with every task")
    words, counts = vocab["word"].to_pylist(), vocab["cn"].to_numpy()
    codes, points = huffman_paths(counts)
    index, shared = (spark.sparkContext.broadcast(x) for x in ({x: i for i, x in enumerate(words)}, (counts, codes, points)))
    unused = np.zeros((0, d), "f4")
    tables = [((np.random.default_rng(c.seed).random((n, d)) - 0.5) / d).astype("f4"), np.zeros((n, d), "f4") if c.hs else unused, np.zeros((n, d), "f4") if c.negative else unused]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value.get
        for b in batches:
            lists = b.column(0).fill_null([])
            ids = np.fromiter(map(of, lists.flatten().to_pylist(), repeat(-1)), "<i4")
            known = [x[x >= 0].tobytes() for x in np.split(ids, np.cumsum(lists.value_lengths().to_numpy())[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.binary())], ["ids"])

    # ids are shuffled, not words; they are read once for each iteration
    corpus = tokens.select("tokens").mapInArrow(encode, "ids binary").repartition(c.partitions)
    if c.iterations > 1:
        corpus = staged(corpus).repartition(c.partitions)
    for k in range(c.iterations):
        weights = spark.sparkContext.broadcast(tables)

        def train(batches: Iterator[pa.RecordBatch], k: int = k, weights=weights) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            counts, codes, points = shared.value
            w = _Weights(*(t.copy() for t in weights.value))

            def sentences() -> Iterator[np.ndarray]:
                for b in batches:
                    for ids in b.column(0).to_pylist():
                        known = np.frombuffer(ids, "<i4")
                        for i in range(0, len(known), c.max_sentence):
                            yield known[i : i + c.max_sentence]

            _train(sentences(), w, c, counts, codes, points, np.random.default_rng([c.seed, k, TaskContext.get().partitionId()]))
            for t, (touched, table) in enumerate(zip(w.touched, (w.syn0, w.syn1, w.syn1neg), strict=True)):
                rows = np.flatnonzero(touched) + t * n
                for own in np.split(rows, np.flatnonzero(np.diff(rows // 4096)) + 1) if len(rows) else ():
                    cells = (x.tobytes() for x in (own.astype("<i8"), table[own - t * n].astype("<f4")))
                    yield pa.RecordBatch.from_arrays([pa.array([own[0] // 4096]), *(pa.array([x], pa.binary()) for x in cells)], ["block", "at", "v"])

        def average(parts: pa.Table) -> pa.Table:
            at = np.concatenate([np.frombuffer(x, "<i8") for x in parts["at"].to_pylist()])
            rows, to = np.unique(at, return_inverse=True)
            total, first = np.zeros((len(rows), d)), 0
            for x in parts["v"].to_pylist():  # no row twice in one of them
                own = np.frombuffer(x, "<f4").reshape(-1, d)
                total[to[first : first + len(own)]] += own
                first += len(own)
            mean = (total / np.bincount(to)[:, None]).astype("<f4")
            return pa.table({"at": pa.array([rows.astype("<i8").tobytes()], pa.binary()), "v": pa.array([mean.tobytes()], pa.binary())})

        changed = corpus.mapInArrow(train, "block bigint, at binary, v binary")
        for r in changed.groupBy("block").applyInArrow(average, "at binary, v binary").toLocalIterator():
            at, v = np.frombuffer(r.at, "<i8"), np.frombuffer(r.v, "<f4").reshape(-1, d)
            for t, table in enumerate(tables):
                own = at // n == t
                table[at[own] % n] = v[own]
        weights.destroy()
    index.destroy()
    shared.destroy()
    return Model(spark.createDataFrame(pa.table({"word": words, "vector": _lists(tables[0])}), "word string, vector array<float>"), d)
