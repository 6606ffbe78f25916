"""Sparse matrices as rows (i, j, v); blocks are derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import PLUS_TIMES, BinaryOp, Semiring
from .closed import closed_paths

KEY = ["i", "j"]
#: Sides of the grid of blocks in which all nonzeros of a vector meet all.
BLOCKS = 16


def from_coo(entries: DataFrame) -> DataFrame:
    """Duplicates add up, zeros go."""
    return entries.groupBy(KEY).agg(F.sum("v").alias("v")).where("v <> 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return from_coo(a.unionByName(b))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return from_coo(a.unionByName(b.select("i", "j", (-F.col("v")).alias("v"))))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), KEY)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).select("i", "j", (F.col("a") * F.col("b")).alias("v")).where("v <> 0")


def row_union_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """In rows that both have, entries of either: products where both are, others as they stand."""
    rows = a.select("i").distinct().join(b.select("i").distinct(), "i")
    return a.unionByName(b).join(rows, "i", "left_semi").groupBy(KEY).agg(F.product("v").alias("v")).where("v <> 0")


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).where("b <> 0").select("i", "j", F.try_divide("a", "b").alias("v")).where("v <> 0")


def combine(a: DataFrame, b: DataFrame, op: BinaryOp) -> DataFrame:
    """Any operator over the union, 0 for a missing side."""
    x = a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), KEY, "full")
    return x.select("i", "j", op(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("v"))


def mask(a: DataFrame, m: DataFrame, complement: bool = False) -> DataFrame:
    return a.join(m.select(KEY).distinct(), KEY, "left_anti" if complement else "left_semi").select("i", "j", "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    """a times b over a semiring: one join on the inner index, which adaptive execution splits where it is hot, and a
    partial aggregate by cell."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return semiring.add.reduce(left.join(right, "k"), KEY, semiring.mul(F.col("a"), F.col("b")), "v", F.col("k"))


def gemm(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame) -> DataFrame:
    scaled = lambda m, s: m.select("i", "j", (F.lit(float(s)) * F.col("v")).alias("v"))
    return from_coo(scaled(multiply(a, b), alpha).unionByName(scaled(c, beta)))


def gemv(alpha: float, a: DataFrame, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    """alpha a x + beta y for vectors (idx, val)."""
    ax = a.join(x, F.col("j") == F.col("idx")).select(F.col("i").alias("idx"), (F.lit(float(alpha)) * F.col("v") * F.col("val")).alias("val"))
    return ax.unionByName(y.select("idx", (F.lit(float(beta)) * F.col("val")).alias("val"))).groupBy("idx").agg(F.sum("val").alias("val"))


def rank_one(alpha: float, v: DataFrame, a: DataFrame) -> DataFrame:
    """a + alpha v v': each nonzero meets each, which is the result's own size; in blocks, by hash, of which each is one key of a join."""
    x, block = v.where("val <> 0"), F.pmod(F.xxhash64("idx"), F.lit(BLOCKS)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    rows = x.select(F.col("idx").alias("i"), F.col("val").alias("p"), block.alias("bi"), each.alias("bj"))
    outer = rows.join(x.select(F.col("idx").alias("j"), F.col("val").alias("q"), block.alias("bj"), each.alias("bi")), ["bi", "bj"])
    return from_coo(outer.select("i", "j", (F.lit(float(alpha)) * F.col("p") * F.col("q")).alias("v")).unionByName(a))


def partition_by(a: DataFrame, parts: int, key: str = "i") -> DataFrame:
    """Rows of index k in partition k mod parts; two matrices, or vectors by idx, dealt alike meet without another shuffle on that key."""
    return a.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).repartitionById(parts, "part").drop("part")


def block_destinations(a: DataFrame, b: DataFrame, rows_per_part: int, cols_per_part: int, row_partitions: int, splits: int) -> tuple[DataFrame, DataFrame]:
    """(bi, bj, part) twice: where a product on a grid, its middle dimension split, sends the blocks(bi, bj) of a and of b.

    A block of a goes to the parts of all blocks of the result that it adds to, those with a block of b in its column's row; each
    part is one of `splits` by the middle index. Blocks without a counterpart go nowhere.
    """
    x, y = a.select("bi", F.col("bj").alias("m")).distinct(), b.select(F.col("bi").alias("m"), "bj").distinct()
    part = F.floor(F.col("bi") / F.lit(rows_per_part)) + F.floor(F.col("bj") / F.lit(cols_per_part)) * F.lit(row_partitions)
    met = x.join(y, "m").withColumn("part", (part * F.lit(splits) + F.pmod("m", F.lit(splits))).cast("bigint"))
    return met.select("bi", F.col("m").alias("bj"), "part").distinct(), met.select(F.col("m").alias("bi"), "bj", "part").distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(triangles) of edges(i, j), in either direction and as often as they come: entries from the lesser to the greater end that close a path."""
    up = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return closed_paths(up).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("triangles"))


def stored_rows(a: DataFrame) -> int:
    return a.select("i").distinct().count()


def dimensions(a: DataFrame) -> DataFrame:
    return a.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).cast("bigint").alias("n_rows"), (F.coalesce(F.max("j"), F.lit(-1)) + 1).cast("bigint").alias("n_cols"))


def violations(a: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Cells out of range or stored more than once."""
    return a.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= n_rows) | (F.col("j") >= n_cols))


def horzcat(a: DataFrame, b: DataFrame, a_cols: int) -> DataFrame:
    return a.unionByName(b.select("i", (F.col("j") + F.lit(a_cols)).alias("j"), "v"))


def vertcat(a: DataFrame, b: DataFrame, a_rows: int) -> DataFrame:
    return a.unionByName(b.select((F.col("i") + F.lit(a_rows)).alias("i"), "j", "v"))


def spdiag(v: DataFrame) -> DataFrame:
    return v.where("val <> 0").select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.col("val").alias("v"))


def with_blocks(a: DataFrame, rows_per_block: int, cols_per_block: int) -> DataFrame:
    return a.select("i", "j", "v", F.floor(F.col("i") / F.lit(rows_per_block)).alias("bi"), F.floor(F.col("j") / F.lit(cols_per_block)).alias("bj"))


def grid_partition(blocks: DataFrame, rows_per_part: int, cols_per_part: int, row_partitions: int) -> DataFrame:
    part = F.floor(F.col("bi") / F.lit(rows_per_part)) + F.floor(F.col("bj") / F.lit(cols_per_part)) * F.lit(row_partitions)
    return blocks.withColumn("part", part.cast("bigint"))


def to_local(a: DataFrame, n_rows: int, n_cols: int, limit: int = 1 << 24):
    """A numpy array, for matrices of at most `limit` cells."""
    import numpy as np

    if n_rows * n_cols > limit:
        raise ValueError(f"{n_rows} x {n_cols} is too large for the driver")
    out = np.zeros((n_rows, n_cols))
    for r in a.collect():
        out[r.i, r.j] += r.v
    return out
