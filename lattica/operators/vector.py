"""Sparse vectors as rows (idx, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import FIRST, PLUS_TIMES, TIMES, BinaryOp, Monoid, Semiring, ieee_divide


def from_entries(spark: SparkSession, size: int, entries: list[tuple[int, float]]) -> DataFrame:
    at = [i for i, _ in entries]
    if size <= 0 or len(set(at)) != len(at) or any(not 0 <= i < size for i in at):
        raise ValueError("indices must be distinct and inside a positive size")
    return spark.createDataFrame([(int(i), float(x)) for i, x in entries], "idx bigint, val double")


def violations(v: DataFrame, size: int) -> DataFrame:
    """Indices that are out of range or stand more than once."""
    return v.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("idx") < 0) | (F.col("idx") >= size))


def ones(indices: DataFrame) -> DataFrame:
    return indices.select("idx", F.lit(1.0).alias("val"))


def ids(indices: DataFrame) -> DataFrame:
    return indices.select("idx", F.col("idx").cast("double").alias("val"))


def random(spark: SparkSession, size: int, seed: int) -> DataFrame:
    """Uniform in [0, 1), a function of seed and index alone."""
    unit = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    return spark.range(size).select(F.col("id").alias("idx"), unit.alias("val"))


def is_empty(v: DataFrame) -> bool:
    return v.where("val <> 0").isEmpty()


def densify(v: DataFrame, size: int) -> DataFrame:
    return v.sparkSession.range(size).withColumnRenamed("id", "idx").join(v, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


def lookup(v: DataFrame, i: int) -> float:
    found = v.where(F.col("idx") == i).select("val").head()
    return found[0] if found else 0.0


def map_active(v: DataFrame, fn) -> DataFrame:
    return v.select("idx", fn(F.col("idx"), F.col("val")).alias("val"))


def scale(v: DataFrame, s: float, op: BinaryOp = TIMES) -> DataFrame:
    """op(s, val); explicit zeros stay."""
    return v.select("idx", op(F.lit(float(s)), F.col("val")).alias("val"))


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("idx", F.col("val").alias("a")).join(b.select("idx", F.col("val").alias("b")), "idx", how)


def cooperate(a: DataFrame, b: DataFrame, monoid: Monoid, keep_zeros: bool = True) -> DataFrame:
    """op over the union of indices, with the identity where a side has none."""
    fill = lambda c: F.coalesce(F.col(c), F.lit(float(monoid.identity)))
    out = _sides(a, b, "full").select("idx", monoid.op(fill("a"), fill("b")).alias("val"))
    return out if keep_zeros else out.where("val <> 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union and sum, without zeros: one partial aggregate rather than an outer join."""
    return a.unionByName(b).groupBy("idx").agg(F.sum("val").alias("val")).where("val <> 0")


def multiply_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-sided entries pass through; zeros go."""
    return a.unionByName(b).groupBy("idx").agg(F.product("val").alias("val")).where("val <> 0")


def multiply_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b, "inner").select("idx", (F.col("a") * F.col("b")).alias("val")).where("val <> 0")


def multiply_zero_filled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product over the union with 0 for a missing side; explicit zeros stay."""
    return _sides(a, b, "full").select("idx", (F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("val"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where both are stored and the divisor is not 0; zeros go."""
    return _sides(a, b, "inner").where("b <> 0").select("idx", F.try_divide("a", "b").alias("val")).where("val <> 0")


def divide_zero_filled(a: DataFrame, b: DataFrame) -> DataFrame:
    """0 where a side is missing, IEEE division where both are."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return _sides(a, b, "full").select("idx", F.when(both, ieee_divide(F.col("a"), F.col("b"))).otherwise(F.lit(0.0)).alias("val"))


def mask(v: DataFrame, m: DataFrame, complement: bool = False) -> DataFrame:
    """Entries whose index the mask has, or with complement those it has not."""
    return v.join(m.select("idx").distinct(), "idx", "left_anti" if complement else "left_semi").select("idx", "val")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b, "inner").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"))


def vxm(v: DataFrame, matrix: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    """v times matrix(i, j, v): only reached columns appear. A join, then a partial aggregate by column."""
    product = semiring.mul(F.col("val"), F.col("v"))
    reached = v.join(matrix, F.col("idx") == F.col("i"))
    return semiring.add.reduce(reached, ["j"], product, "val", F.col("i")).select(F.col("j").alias("idx"), "val")


def collect(v: DataFrame) -> list[tuple[int, float]]:
    return [(r.idx, r.val) for r in v.orderBy("idx").collect()]


def first_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return cooperate(a, b, Monoid(FIRST, 0.0))
