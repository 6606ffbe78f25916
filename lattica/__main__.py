"""python -m lattica --cmd ... --input ... --output ..."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import linkpred, partition, walk, word2vec
from .operators.graph import Graph
from .params import Params, parse
from .session import session
from .sources.text import read_corpus, read_embeddings, read_pairs, write_walks


def assigned(graph: Graph, p: Params) -> DataFrame:
    return partition.ldg_partition(graph, p.partitions) if p.partitioner == "ldg" else partition.lpt_partition(graph.degrees(), p.partitions)


def walks(graph: Graph, p: Params) -> DataFrame:
    """Walks over relabelled ids, as many as numWalks from each node, of walkLength steps."""
    ids = partition.relabel(assigned(graph, p))
    matrix = graph.to_matrix(ids).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return walk.random_walks(matrix, p.numWalks, p.walkLength)


def embed(tokens: DataFrame, p: Params) -> word2vec.Model:
    return word2vec.fit(tokens, word2vec.Config(vector_size=p.dim, learning_rate=p.lr, partitions=p.partitions, iterations=p.iter, window=p.window, min_count=p.minCount))


def run(spark: SparkSession, p: Params) -> None:
    if p.cmd == "linkPredict":
        linkpred.link_prediction(read_pairs(spark, f"graph/{p.input}", p.directed), read_embeddings(spark, f"emb/{p.input}-One.emb")).write.mode("overwrite").parquet(p.output)
        return
    if p.cmd == "embedding":
        embed(read_corpus(spark, p.input, p.partitions), p).save(f"{p.output}.bin")
        return
    graph = Graph.from_file(spark, p.input, p.weighted, p.directed)
    if p.cmd == "partition":
        partition.edge_cut(graph, assigned(graph, p)).write.mode("overwrite").parquet(p.output)
    elif p.cmd == "randomwalk":
        write_walks(walks(graph, p), p.output, p.partitions)
    else:
        paths = walks(graph, p).select(F.transform("path", lambda x: x.cast("string")).alias("tokens"))
        embed(paths, p).save(f"{p.output}.bin")


if __name__ == "__main__":
    parameters = parse(sys.argv[1:])
    run(session("lattica"), parameters)
