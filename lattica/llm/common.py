"""Shared plumbing for the training-data operators: shared-folder tables, Arrow batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a URI, in the shared folder that the cluster names in spark.checkpoint.dir; discard() empties it.

    Where that setting is absent a temporary folder stands in on a local master (tests); a cluster without it is an error, since
    its nodes would each write to a folder of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lattica-shared")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    _made.add(made := f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return made


def discard(*uris: str) -> None:
    """Deletes what shared_dir() has handed out, or only the given ones of it. Frames that read them are lost; the driver's exit does it."""
    for uri in uris or tuple(_made):
        _made.discard(uri)
        with contextlib.suppress(OSError):
            remove(uri)


atexit.register(discard)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a file under a private name, then renames it: a retried or doubled task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    try:
        fs.move(part, path)
    except OSError:  # a file system that does not rename over the file of another attempt
        fs.delete_file(part)
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise


def get(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def remove(uri: str) -> None:
    fs, path = filesystem(uri)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(path)


def staged_at(df: DataFrame) -> tuple[DataFrame, str]:
    """staged(), and the folder, for discard() once nothing reads it any more."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that a lost executor costs no upstream work."""
    return staged_at(df)[0]


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes, so that long texts don't pile up in a worker.

    The settings are the session's, and stay: plans are lazy, so there is no later point at which to take them back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception as e:  # an older Spark that lacks the setting
        if "CONFIG" not in str(e).upper():
            raise


_trimmed = [0.0]


def trim() -> None:
    """Gives freed memory back, once a second: a Python worker lives on, and what its allocators hold back adds up."""
    if time.monotonic() < _trimmed[0] + 1:
        return
    _trimmed[0] = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


_held: list[Callable[[], None]] = []


def held(clear: Callable[[], None]) -> None:
    """Names what empties a cache that outlives tasks."""
    _held.append(clear)


def release() -> None:
    """Empties the caches that other operators left in this worker; for stages that need its memory themselves."""
    for clear in _held:
        clear()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One record batch in, one out; nothing is held between batches but what fn caches itself."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings, with null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def string_column(df: DataFrame, name: str = "text") -> F.Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def partitions_for(rows: DataFrame, column: str, each: int) -> int:
    """Partitions that hold some `each` bytes of a column, as many as the session's shuffle partitions at least."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable, for nodes 0..n-1 under edges a-b: label minima with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is a partial aggregate and an equi-join that adaptive execution
    may split, so a hub's edges never meet in one task. Every round is written to the shared folder, and the one before deleted.
    The rounds needed grow at most with the square of the logarithm of the edges; beyond that something is wrong.
    """
    e, path = staged_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # under another name than what it was grouped by: a plain shuffle on both sides, so that a hub's edges can be split
        linked = near.join(low.select(F.col("u").bitwiseXOR(F.lit(0)).alias("k"), "m"), F.col("u") == F.col("k")).drop("k")
        if large:
            return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionAll(own).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(10 + math.ceil(math.log2(before[0] + 1)) ** 2):
        if not before[0]:
            break
        e, done = staged_at(star(star(e, True), False))
        discard(path)
        path = done
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def component_lows(classes: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    """(name, low): for each of classes(name, low) the least low of its component, by reached(node, component).

    A class of no component keeps its own. The least are written first, so that the join of a large component is one of
    two plain shuffles, which adaptive execution splits or turns into a broadcast of checked size.
    """
    wide = staged(classes.join(reached, F.col(name) == F.col("node"), "left").select(name, "low", "component"))
    lows = staged(wide.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("least")))
    linked = wide.where("component IS NOT NULL").join(lows, "component").select(name, F.col("least").alias("low"))
    return wide.where("component IS NULL").select(name, "low").unionAll(linked)


#: Bits of the bitmaps that tasks hold, of hashes: 4 MB whatever the input.
BITS = 1 << 25


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """BITS bits, of which those at the values' low bits are set."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, "i8")
    out[words["w"].to_numpy("i8")] = words["bits"].to_numpy("i8")
    return out


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def kept_rows(rows: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """rows but those whose keys are gone by decided(keys, gone, repeated); of rows alike in all columns one stays where repeated.

    The first key is a hash. Two bitmaps settle most rows where they lie: what is not among the gone stays, what is not
    among the kept goes. Only the others, which chance or repetition puts into both, are shuffled and joined; when the bitmaps are
    full, those are all that have a gone row's hash bits.
    """
    at, sc = keys[0], rows.sparkSession.sparkContext
    gone, kept = (sc.broadcast(bitmap(decided.where(c), at)) for c in ("gone OR repeated", "NOT gone"))

    @F.pandas_udf("int")
    def settled(x: pd.Series) -> pd.Series:
        h = x.to_numpy("i8")
        return pd.Series(np.where(in_bitmap(gone.value, h), np.where(in_bitmap(kept.value, h), 2, 1), 0).astype("i4"))

    told = rows.withColumn("__settled", settled(at))
    lost = decided.where("gone").select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rest = told.where("__settled = 2").drop("__settled").join(lost, same, "left_anti")
    again = decided.where("repeated").select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    one = rest.join(again, same, "left_semi").dropDuplicates()
    return told.where("__settled = 0").drop("__settled").unionAll(rest.join(again, same, "left_anti")).unionAll(one)
