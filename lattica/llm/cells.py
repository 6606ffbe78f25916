"""Deals rows into cells, the buckets of a hash table, for pair searches inside each; large cells become blocks.

A cell with more rows than `limit` is split into B blocks by hash; each row goes to the B cells (i, j) of its block and any
other, so every pair of rows still meets exactly once and no task holds more than two blocks of a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Large cells are broadcast up to this many, some 400 kB; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 10_000


def deal(rows: DataFrame, sizes: DataFrame, limit: int, salt: str) -> DataFrame:
    """rows(t, key, ...) with lo, hi, own: the cell's two blocks and the row's own. sizes(t, key) has a row for each row.

    Where there are large cells, their block numbers come by a broadcast of checked size or else by an equi-join that
    adaptive execution may split where a cell is hot.
    """
    counted = sizes.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = staged(counted.select(F.col("t").alias("lt"), F.col("key").alias("lkey"), F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("blocks")))
    n_large = large.count()
    if not n_large:
        return rows.withColumns({c: F.lit(0) for c in ("own", "lo", "hi")})
    if n_large <= BROADCAST_CELLS:
        large = F.broadcast(large)
    joined = rows.join(large, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lkey")), "left").drop("lt", "lkey")
    own = joined.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(salt), F.col("blocks").cast("bigint")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return met.drop("other", "blocks")


def grouped(dealt: DataFrame, n_rows: int, target: int = 20_000) -> DataFrame:
    """With grp, so that a group holds some `target` rows' worth of whole cells."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * parts, -(-n_rows // target))
    return dealt.withColumn("grp", F.pmod(F.xxhash64("t", "key", "lo", "hi"), F.lit(groups)))
