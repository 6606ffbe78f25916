"""Link prediction: negative sampling, cosine scores, area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import dot, norm
from ..plans.lineage import cut, with_row_index


def node_list(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _place(h: Column, n: int) -> Column:
    """A place below n by the first 48 bits of an md5."""
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), F.lit(max(n, 1)))


def negatives_by_pair(edges: DataFrame, nodes: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """The first ratio * edges distinct pairs (u < v) of nodes, in the order they are drawn, that are no edge; all of them if there are fewer.

    Draw t takes the nodes at md5(seed:t:0) and md5(seed:t:1) of the sorted node list. Draws are made twice as many as are wanted, and
    again twice as many until they are enough; how many at once does not change the result, and no product of the nodes is made.
    """
    spark = edges.sparkSession
    index = with_row_index(nodes.select("node"), F.asc("node"), name="k")
    n = index.count()
    known = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    inside = known.join(index.select(F.col("node").alias("u")), "u", "left_semi").join(index.select(F.col("node").alias("v")), "v", "left_semi").count()
    want = min(int(ratio * edges.count()), n * (n - 1) // 2 - inside)
    tries = 2 * want
    while True:
        at = spark.range(tries).select(F.col("id").alias("t"), *(_place(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(end)))), n).alias(f"k{end}") for end in (0, 1)))
        drawn = at.where("k0 <> k1").join(index.select(F.col("k").alias("k0"), F.col("node").alias("a")), "k0").join(index.select(F.col("k").alias("k1"), F.col("node").alias("b")), "k1")
        pairs = drawn.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("t").alias("t")).join(known, ["u", "v"], "left_anti")
        ranked = with_row_index(pairs, F.asc("t"), name="place")
        if ranked.count() >= want:
            return ranked.where(F.col("place") < want).select("u", "v")
        tries *= 2


def negatives_by_node(edges: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(u, v): for each u with int(ratio * degree) = n, up to n of n + degree drawn nodes that are no neighbours of u.

    Draws are md5-keyed places in the sorted node list, with replacement, then distinct; u itself is no candidate here. A node's draws
    number as its edges; they are made one row each, and their places in one distributed order tell those among a node's own, so
    that a hub's candidates are not one task's.
    """
    nodes = with_row_index(node_list(edges), F.asc("node"), name="k")
    total = nodes.count()
    pairs = edges.select("u", "v").distinct()
    degrees = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d")).withColumn("n", F.floor(F.lit(ratio) * F.col("d")).cast("int")).where("n > 0")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("u").cast("string"), F.col("t").cast("string")))
    drawn = degrees.select("u", "n", F.explode(F.sequence(F.lit(1), (F.col("n") + F.col("d")).cast("int"))).alias("t")).withColumn("h", key)
    named = drawn.withColumn("k", _place(F.col("h"), total)).join(nodes, "k").select("u", "n", F.col("node").alias("v"), "h").where("u <> v")
    first = named.groupBy("u", "v").agg(F.min("h").alias("h"), F.first("n").alias("n")).join(pairs, ["u", "v"], "left_anti")
    placed = with_row_index(first, F.asc("u"), F.asc("h"), F.asc("v"), name="place")
    begins = placed.groupBy("u").agg(F.min("place").alias("begin"))
    return placed.join(begins, "u").where(F.col("place") - F.col("begin") < F.col("n")).select("u", "v")


def edge_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with the cosine of their nodes' vectors(node, vec); pairs without one, or of zero norm, are dropped."""
    a = vectors.select(F.col("node").alias("u"), F.col("vec").alias("x"), norm(F.col("vec")).alias("nx")).where("nx > 0")
    b = vectors.select(F.col("node").alias("v"), F.col("vec").alias("y"), norm(F.col("vec")).alias("ny")).where("ny > 0")
    scored = pairs.join(a, "u").join(b, "v").withColumn("score", dot(F.col("x"), F.col("y")) / (F.col("nx") * F.col("ny")))
    return scored.drop("x", "y", "nx", "ny").where(~F.isnan("score"))


def auc(scored: DataFrame) -> DataFrame:
    """(auc): by pair counting over scored(score, label), ties counted half.

    Scores are counted first; what is ordered are distinct scores, by a distributed index rather than one sort task.
    """
    per = scored.groupBy("score").agg(F.sum((F.col("label") == 1).cast("bigint")).alias("p"), F.sum((F.col("label") != 1).cast("bigint")).alias("n"))
    placed = per.repartitionByRange("score").withColumn("slot", F.spark_partition_id())
    placed = cut(placed)
    sums = placed.groupBy("slot").agg(F.sum("n").alias("n")).select(F.col("slot").alias("s"), F.col("n").alias("m"))  # a row a partition
    below = placed.select("slot").distinct().join(F.broadcast(sums), F.col("s") < F.col("slot"), "left").groupBy("slot").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("slot").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = placed.withColumn("low", inside).join(F.broadcast(below), "slot")
    return won.agg((F.sum(F.col("p") * (F.col("low") + F.col("base")) + F.col("p") * F.col("n") / F.lit(2.0)) / (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def auc_by_order(scored: DataFrame) -> DataFrame:
    """(auc): rank sum with ties in the order of label, not averaged."""
    ranked = with_row_index(scored.select("score", "label"), F.asc("score"), F.asc("label"), name="k")
    p, n = F.sum((F.col("label") == 1).cast("bigint")), F.sum((F.col("label") != 1).cast("bigint"))
    ranks = F.sum(F.when(F.col("label") == 1, F.col("k") + 1).otherwise(0))
    return ranked.agg(((ranks - p * (p + 1) / F.lit(2.0)) / (p * n).cast("double")).alias("auc"))


def link_prediction(edges: DataFrame, vectors: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """(auc) of cosine scores for edges(u, v) against negatives drawn for each node."""
    positive = edge_scores(edges.select("u", "v"), vectors).select("score", F.lit(1).alias("label"))
    negative = edge_scores(negatives_by_node(edges, ratio, seed), vectors).select("score", F.lit(0).alias("label"))
    return auc(positive.unionByName(negative))
