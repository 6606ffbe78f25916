"""Plan plumbing: reliable lineage cuts and a distributed row index."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the folder that all executors share; a local folder only where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder stands in on a local master only, where all tasks see it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "lattica-checkpoints")


def staged(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder, computed once where a checkpoint computes its last stage twice; the driver's exit deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing holds any more: it does once the driver's JVM has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def with_row_index(df: DataFrame, *order: Column, name: str = "row_index") -> DataFrame:
    """A gapless index from 0 in the given order, without a single-task sort: range partitions, then each one's offset."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    at = placed.withColumn("__p", F.shiftright("__m", 33))
    counts = at.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    offset, rows = 0, []
    for r in sorted(counts):
        rows.append((r["__p"], offset))
        offset += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("__p", T.LongType()), T.StructField("__o", T.LongType())]))
    return at.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__o")
