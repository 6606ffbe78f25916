"""Graphs as edge DataFrames (src, dst[, weight]) and the views derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import read_edges


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    directed: bool = False

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, weighted: bool = True, directed: bool = False) -> Graph:
        return cls(read_edges(spark, path, weighted), directed)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def num_edges(self) -> int:
        """Rows as given: an undirected edge once, duplicates and self-loops too."""
        return self.edges.count()

    def nodes(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()

    def edge_list(self) -> DataFrame:
        return self.edges.select("src", "dst")

    def triplets(self) -> DataFrame:
        return self.edges.select("src", "dst", F.col("weight").cast("double") if self.weighted else F.lit(1.0).alias("weight"))

    def arcs(self) -> DataFrame:
        """(src, dst, weight), both ways if undirected (a self-loop twice); one scan, no union."""
        t = self.triplets()
        if self.directed:
            return t
        both = F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
        return t.select(both.alias("e")).select("e.*")

    def adjacency(self) -> DataFrame:
        """(src, adj) with adj sorted by neighbour and weight; nodes without out-edges are absent."""
        return self.arcs().groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("adj"))

    def neighbors(self) -> DataFrame:
        """(node, nbrs), duplicates kept, sorted."""
        return self.arcs().groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))

    def degrees(self) -> DataFrame:
        return self.arcs().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))

    def to_matrix(self, ids: DataFrame, ids_as_values: bool = False, strict: bool = False) -> DataFrame:
        """(i, j, v) by node ids(node, id). Edges with an endpoint that has no id vanish, or raise if strict.

        With ids_as_values, v is the row's index and duplicates go; otherwise v is 1 for each edge.
        """
        how = "left" if strict else "inner"
        a = ids.select(F.col("node").alias("src"), F.col("id").alias("i"))
        b = ids.select(F.col("node").alias("dst"), F.col("id").alias("j"))
        m = self.arcs().select("src", "dst").join(a, "src", how).join(b, "dst", how)
        if strict:
            bad = F.raise_error(F.concat(F.lit("no id for an endpoint of "), F.col("src").cast("string"), F.lit(" - "), F.col("dst").cast("string")))
            m = m.withColumn("i", F.when(F.col("i").isNull() | F.col("j").isNull(), bad).otherwise(F.col("i")))
        m = m.select("i", "j", F.col("i").cast("double").alias("v") if ids_as_values else F.lit(1.0).alias("v"))
        return m.distinct() if ids_as_values else m

    def unpersist(self) -> None:
        self.edges.unpersist()
