"""Random walks: a step is one vector-matrix product; all walkers on a node move together.

The draw of node u at a step of a walk is md5(seed:walk:step:u), compared as text, so that any engine gives the same walks.
Walkers without a next hop are dropped, or stay where they are with keep_stuck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def draw(seed: int, walk: Column, step: int, node: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), walk.cast("string"), F.lit(str(step)), node.cast("string")))


def _rounds(walks: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(walks - 1).cast("bigint")))


def step_table(arcs: DataFrame, walks: int, step: int, seed: int) -> DataFrame:
    """(walk, node, next): for each node with an in-neighbour, that of the greatest draw (ties: the greatest id)."""
    return _hops(arcs.select("src", "dst").distinct(), walks, step, seed)


def _hops(pairs: DataFrame, walks: int, step: int, seed: int) -> DataFrame:
    """Draws are made once a node and walk, then joined; a hub's arcs are reduced before they are shuffled."""
    drawn = pairs.select("src").distinct().select("src", _rounds(walks).alias("walk"))
    drawn = drawn.withColumn("r", draw(seed, F.col("walk"), step, F.col("src")))
    return pairs.join(drawn, "src").groupBy("walk", "dst").agg(F.max(F.struct("r", "src")).alias("m")).select("walk", F.col("dst").alias("node"), F.col("m.src").alias("next"))


class _Paths:
    """Paths in pieces: every few steps the piece so far is cut off and kept, so a step's shuffle carries few nodes of a walk, however
    long it is. The pieces of a walk meet once, at the end; walks that lack one were dropped."""

    def __init__(self, length: int, cut_every: int):
        self.length, self.cut_every, self.pieces = length, cut_every, []

    def after(self, step: int, paths: DataFrame) -> DataFrame:
        if step % self.cut_every or step == self.length:
            return paths
        done = cut(paths)
        self.pieces.append(done.select("walk", "src", F.lit(step).alias("at"), "path"))
        return done.withColumn("path", F.slice("path", 1, 0))

    def whole(self, paths: DataFrame) -> DataFrame:
        last = paths.select("walk", "src", "path")
        if not self.pieces:
            return last
        every = last.select("walk", "src", F.lit(self.length).alias("at"), "path")
        for p in self.pieces:
            every = every.unionAll(p)
        # a walk has one piece a cut, so the list is bounded by the length
        met = every.groupBy("walk", "src").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("pieces"))
        return met.where(F.size("pieces") == len(self.pieces) + 1).select("walk", "src", F.flatten(F.col("pieces.path")).alias("path"))


def random_walks(arcs: DataFrame, walks: int, length: int, seed: int = 42, keep_stuck: bool = False, cut_every: int = 5) -> DataFrame:
    """(walk, src, path): a path of length + 1 nodes from every node, for each of the walks, all in one frame."""
    pairs = cut(arcs.select("src", "dst").distinct())
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    paths = nodes.select(_rounds(walks).alias("walk"), "src", F.col("src").alias("cur"), F.array("src").alias("path"))
    pieces = _Paths(length, cut_every)
    for k in range(1, length + 1):
        hop = _hops(pairs, walks, k, seed).select("walk", F.col("node").alias("cur"), "next")
        paths = paths.join(hop, ["walk", "cur"], "left" if keep_stuck else "inner")
        to = F.coalesce("next", "cur")
        paths = paths.select("walk", "src", to.alias("cur"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array(to))).alias("path"))
        paths = pieces.after(k, paths)
    return pieces.whole(paths)


def weighted_walks(arcs: DataFrame, walks: int, length: int, seed: int = 42, cut_every: int = 5) -> DataFrame:
    """Beyond the coalescing walks: each walker chooses an out-arc for itself, by weight (an exponential race of md5 draws)."""
    nodes = arcs.select("src").distinct()
    paths = nodes.select(_rounds(walks).alias("walk"), "src", F.col("src").alias("cur"), F.array("src").alias("path"))
    pieces = _Paths(length, cut_every)
    out = arcs.where("weight > 0").select(F.col("src").alias("cur"), "dst", "weight")
    for k in range(1, length + 1):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("walk").cast("string"), F.col("src").cast("string"), F.lit(str(k)), F.col("dst").cast("string")))
        unit = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
        raced = paths.join(out, "cur").withColumn("t", -F.log(unit) / F.col("weight"))
        best = raced.groupBy("walk", "src").agg(F.min_by(F.struct("dst", "path"), F.struct("t", "dst")).alias("b"))
        paths = best.select("walk", "src", F.col("b.dst").alias("cur"), F.concat("b.path", F.array("b.dst")).alias("path"))
        paths = pieces.after(k, paths)
    return pieces.whole(paths)
