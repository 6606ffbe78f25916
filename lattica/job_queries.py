"""Queries of sources, sinks and saved models: each writes what it reads to the shared folder first. And of a job's settings."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import estimator, matrix, vector, walk, word2vec
from .operators.graph import Graph
from .params import parse
from .plans.lineage import shared_folder
from .queries import AB_SQL, NN_SQL, SEED, SP_SQL, UV_SQL, WALKS, _walk_sql, a_b, nn, query, sp, table, u_w, vectors
from .sources import text


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/text-{uuid.uuid4().hex}"


def _written(lines: DataFrame) -> str:
    path = _path(lines.sparkSession)
    lines.write.text(path)
    return path


@query(f"WITH {SP_SQL} SELECT src, dst FROM sp")
def source_edges(spark, d):
    """Lines of two ids, and of two ids and more that is ignored."""
    e = sp(spark, d).edges
    path = _written(e.select(F.concat_ws(" ", "src", "dst", F.when(F.col("dst") % 2 == 0, F.lit("7.5 x"))).alias("value")))
    return Graph.from_file(spark, path, weighted=False).edges


@query(f"WITH {NN_SQL} SELECT i AS src, j AS dst, CASE i % 3 WHEN 0 THEN v WHEN 1 THEN CAST(j AS DOUBLE) ELSE 1.0::DOUBLE END AS weight FROM nn")
def source_weighted_edges(spark, d):
    """Lines with a weight; of two ids, whose second is the weight; and with a last field that is no number."""
    kind, head = F.col("i") % 3, F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"))
    line = F.when(kind == 0, F.concat_ws("\t", head, F.col("v").cast("string"))).when(kind == 1, head).otherwise(F.concat_ws("\t", head, F.lit("none")))
    return Graph.from_file(spark, _written(nn(spark, d).select(line.alias("value"))), weighted=True).edges


@query(f"WITH {SP_SQL} SELECT src AS u, dst AS v FROM arcs")
def source_pairs(spark, d):
    """Edges for link prediction, both ways."""
    return text.read_pairs(spark, _written(sp(spark, d).edges.select(F.concat_ws(" ", "src", "dst").alias("value"))))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS word FROM documents) GROUP BY 1")
def source_corpus(spark, d):
    """Words of a corpus of one text a line."""
    lines = table(spark, d, "documents").select(F.trim(F.regexp_replace("text", r"\s+", " ")).alias("value")).where("value IS NOT NULL")
    return text.read_corpus(spark, _written(lines), 8).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_CELLS = "SELECT vec_id AS node, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(_CELLS)
def source_embeddings(spark, d):
    lines = vectors(spark, d).select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("vec", lambda x: x.cast("string"))).alias("value"))
    return text.read_embeddings(spark, _written(lines)).select("node", F.posexplode("vec").alias("k", "x")).select("node", F.col("k").cast("bigint").alias("k"), "x")


@query(f"{_walk_sql(3)} SELECT path AS value FROM w3")
def sink_walks(spark, d):
    """Walks written as text in eight files and read again as lines."""
    path = _path(spark)
    text.write_walks(walk.random_walks(sp(spark, d).arcs(), WALKS, 3, SEED), path, 8)
    return spark.read.text(path)


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))


_MODEL = f"SELECT CAST(node AS VARCHAR) AS word, k, x FROM ({_CELLS})"


def _cells(v: DataFrame) -> DataFrame:
    return v.select("word", F.posexplode("vector").alias("k", "x")).select("word", F.col("k").cast("bigint").alias("k"), F.col("x").cast("double").alias("x"))


@query(_MODEL)
def model_saved(spark, d):
    """A trainer's model, saved and loaded."""
    path = _path(spark)
    word2vec.Model(_words(spark, d), 64).save(path)
    return _cells(word2vec.Model.load(spark, path).vectors)


@query(_MODEL)
def ml_model_saved(spark, d):
    """A pipeline model, saved and loaded, by its own vectors."""
    path = _path(spark)
    estimator.WordEmbeddingModel(word2vec.Model(_words(spark, d), 64)).write().save(path)
    return _cells(estimator.WordEmbeddingModel.load(path).getVectors())


@query(f"WITH x AS ({_CELLS}), t AS (SELECT conv_id, unnest(list_transform([0, 1, 10 ** 9], lambda i: CAST(conv_id + i AS BIGINT))) AS node FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, k, round(sum(x) / 3, 5) AS x FROM t JOIN x USING (node) GROUP BY 1, 2")
def ml_transform(spark, d):
    """Means of the vectors of three words each, of which one is unknown."""
    docs = table(spark, d, "conversations").select("conv_id").distinct().withColumn("words", F.array(*((F.col("conv_id") + i).cast("string") for i in (0, 1, 10**9))))
    model = estimator.WordEmbeddingModel(word2vec.Model(_words(spark, d), 64))
    model.set(model.inputCol, "words")
    model.set(model.outputCol, "mean")
    out = model.transform(docs).select("conv_id", F.posexplode(vector_to_array("mean")).alias("k", "x"))
    known = table(spark, d, "embeddings").agg(F.max("vec_id").alias("last"))
    return out.join(F.broadcast(known)).where("conv_id <= last").select("conv_id", F.col("k").cast("bigint").alias("k"), F.round("x", 5).alias("x"))


@query("SELECT * FROM (VALUES ('cmd', 'partition'), ('dim', '128'), ('directed', 'True'), ('indexed', 'True'), ('input', 'a'), ('iter', '10'), ('lr', '0.025'), ('minCount', '0'), ('nodePath', 'None'), ('numWalks', '10'), ('output', 'b'), ('p', '1.0'), ('partitioner', 'ldg'), ('partitions', '10'), ('q', '2.5'), ('walkLength', '80'), ('weighted', 'True'), ('window', '10')) t(name, value)")
def job_settings(spark, d):
    """Given parameters, and the defaults of all others."""
    p = parse(["--input", "a", "--output", "b", "--cmd", "partition", "--partitioner", "ldg", "--q", "2.5", "--directed", "true"])
    return spark.createDataFrame(sorted((k, str(v)) for k, v in vars(p).items()), "name string, value string")


@query("SELECT * FROM (VALUES ('vector_size', 100.0::DOUBLE), ('learning_rate', 0.025), ('partitions', 1), ('iterations', 1), ('seed', 42), ('window', 5), ('min_count', 5), ('max_sentence', 1000), ('cbow', 0), ('sample', 0), ('hs', 1), ('negative', 0)) t(name, value)")
def trainer_settings(spark, d):
    return spark.createDataFrame([(k, float(v)) for k, v in vars(word2vec.Config()).items()], "name string, value double")


@query("SELECT * FROM (VALUES ('vector_size', 0.0::DOUBLE, true), ('learning_rate', 0, true), ('learning_rate', 1, false), ('learning_rate', 1.5, true), ('sample', 1, false), ('sample', 1.5, true), ('partitions', 0, true), ('iterations', -1, true), ('window', 0, true), ('min_count', -1, true), ('max_sentence', 0, true), ('negative', -1, true), ('hs', 0, true)) t(name, value, refused)")
def trainer_refusals(spark, d):
    """Values out of range; and neither of the two kinds of output."""
    cases = [("vector_size", 0), ("learning_rate", 0), ("learning_rate", 1), ("learning_rate", 1.5), ("sample", 1), ("sample", 1.5), ("partitions", 0), ("iterations", -1), ("window", 0), ("min_count", -1), ("max_sentence", 0), ("negative", -1), ("hs", 0)]

    def refused(name: str, value: float) -> bool:
        try:
            word2vec.Config(**{name: value})
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(n, float(v), refused(n, v)) for n, v in cases], "name string, value double, refused boolean")


# dealing


@query(f"WITH {UV_SQL} SELECT idx, val, CAST(idx % 8 AS INTEGER) AS part FROM u")
def vec_partition_by(spark, d):
    return matrix.partition_by(u_w(spark, d)[0], 8, "idx").select("idx", "val", F.spark_partition_id().alias("part"))


@query(f"WITH {AB_SQL} SELECT i, j, v, CAST(i % 8 AS INTEGER) AS part FROM a")
def mat_partition_by(spark, d):
    return matrix.partition_by(a_b(spark, d)[0], 8).select("i", "j", "v", F.spark_partition_id().alias("part"))


@query(f"WITH {UV_SQL} SELECT u.idx, u.val * w.val AS val, CAST(u.idx % 8 AS INTEGER) AS part FROM u JOIN w ON u.idx = w.idx")
def vec_co_partitioned(spark, d):
    """Two vectors that are dealt alike, multiplied where they lie."""
    u, w = (matrix.partition_by(x, 8, "idx").sortWithinPartitions("idx") for x in u_w(spark, d))
    return vector.multiply_intersect(u, w.hint("merge")).select("idx", "val", F.pmod("idx", F.lit(8)).cast("int").alias("part"))


_GRID = "x AS (SELECT DISTINCT i // 4 AS bi, j // 4 AS m FROM nn WHERE v > 0), y AS (SELECT DISTINCT i // 4 AS m, j // 4 AS bj FROM nn WHERE v > 0), met AS (SELECT bi, m, bj, (bi // 2 + bj // 3 * 4) * 2 + m % 2 AS part FROM x JOIN y USING (m))"


def _destinations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = matrix.with_blocks(nn(spark, d), 4, 4)
    return matrix.block_destinations(blocks, blocks, 2, 3, 4, 2)


@query(f"WITH {NN_SQL}, {_GRID} SELECT DISTINCT bi, m AS bj, part FROM met")
def mat_left_destinations(spark, d):
    return _destinations(spark, d)[0]


@query(f"WITH {NN_SQL}, {_GRID} SELECT DISTINCT m AS bi, bj, part FROM met")
def mat_right_destinations(spark, d):
    return _destinations(spark, d)[1]
