"""Text sources and sinks: edge lists, corpora, embeddings, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", r"\s").alias("parts"))


def read_edges(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    """(src, dst[, weight]) from lines of fields one white space apart; further fields are ignored, malformed ids raise.

    The weight is the last field if it is a number, else 1; so a line of two ids has its second id as weight.
    """
    src, dst = F.col("parts")[0].cast("bigint").alias("src"), F.col("parts")[1].cast("bigint").alias("dst")
    weight = F.coalesce(F.expr("try_cast(element_at(parts, -1) AS double)"), F.lit(1.0)).alias("weight")
    return _parts(spark, path).select(src, dst, *([weight] if weighted else []))


def read_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    tokens = _parts(spark, path).select(F.col("parts").alias("tokens"))
    return tokens.repartition(partitions) if partitions else tokens


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec) from lines of a node and its components."""
    return _parts(spark, path).select(F.col("parts")[0].cast("bigint").alias("node"), F.expr("slice(parts, 2, greatest(size(parts) - 1, 0))").cast("array<double>").alias("vec"))


def read_pairs(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """(u, v); undirected pairs both ways."""
    e = read_edges(spark, path, weighted=False).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return e if directed else e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def walk_lines(walks: DataFrame) -> DataFrame:
    return walks.select(F.concat_ws(" ", F.transform("path", lambda x: x.cast("string"))).alias("value"))


def write_walks(walks: DataFrame, path: str | None, partitions: int) -> None:
    """Nothing is written without a path."""
    if path:
        walk_lines(walks).repartition(partitions).write.text(path)
