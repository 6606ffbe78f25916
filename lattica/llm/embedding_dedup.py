"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosine, distributed components.

Equal vectors are one class. Classes meet in the cells of each table; every pair in a cell is verified in double precision,
in blocks where a cell is large, and counted in the first table in which its two keys agree, so pairs are neither written
out nor counted twice. The number of bits follows the number of classes, and that of tables follows the bits, so that a
pair at the threshold itself is missed with at most the stated probability.

A vector that is null, empty, zero, or holds null or non-finite components links with nothing, as do rows without an id and vectors
of different lengths. Rows repeat as they come; rows of equal id and different vectors share a component. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import deal, grouped
from .common import connected_components, local_components, map_arrow, staged

BLOCK = 1024
NUMBER = {"float": "<f4", "double": "<f8"}


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = max(6, min(30, math.ceil(math.log2(max(n, 2) / 256))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def usable(column: F.Column) -> F.Column:
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & good & F.exists(column, lambda x: x != 0), F.lit(False))


def sign_keys(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(cid, n, vec binary of the components as they come, keys binary of 4-byte ints)."""
    kind = NUMBER[classes.schema["embedding"].dataType.elementType.simpleString()]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, vecs = [], []
        for v in b.column(2).to_pylist():
            y = np.array(v, kind)
            x = y.astype("f8")
            x /= np.abs(x).max()  # components may be too large or too small to square
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((len(x), tables * bits))
            sign = (x @ planes[len(x)] > 0).reshape(tables, bits)
            keys.append((sign @ (1 << np.arange(bits))).astype("<i4").tobytes())
            vecs.append(y.tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], ["cid", "n", "vec", "keys"])

    planes: dict[int, np.ndarray] = {}
    return map_arrow(classes.select("cid", "n", "embedding"), run, "cid bigint, n bigint, vec binary, keys binary")


def table_keys(keyed: DataFrame, tables: int, *columns: str) -> DataFrame:
    """The given columns, t and key, a row for each table; a key is the 8 hex digits of its bytes, and the vector's length."""
    digits = F.array(*(F.struct(F.lit(t).alias("t"), F.substring("keys", 4 * t + 1, 4).alias("k")) for t in range(tables)))
    return keyed.select(*columns, F.length("vec").alias("size"), F.explode(digits).alias("c")).select(*columns, "c.t", F.xxhash64("c.k", "size").alias("key"))


def vectors(raw: np.ndarray, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("f8")
    return x / np.abs(x).max(1, keepdims=True)


def cell_links(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, t: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, first): linked pairs of a cell, and whether table t is the first in which they meet."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    i, j = np.nonzero((x @ y.T) / (nx[:, None] * ny[None, :]) >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    first = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 18):
        s = slice(lo, lo + (1 << 18))
        first[s] = ~(kx[i[s], :t] == ky[j[s], :t]).any(1)
    return i, j, first


def class_links(keyed: DataFrame, n: int, tables: int, threshold: float, kind: str) -> DataFrame:
    """(cid, links, root): for linked classes, partners' rows counted in a group of cells, and a spanning star there."""
    dealt = grouped(deal(table_keys(keyed, tables, "cid", "n", "vec", "keys"), table_keys(keyed, tables), BLOCK, "cid"), n * tables, 4000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "lo", "hi"], ignore_index=True)
        cell = pdf.groupby(["t", "key", "lo", "hi"], sort=False).ngroup().to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        ids, at = np.unique(pdf["cid"].to_numpy("i8"), return_inverse=True)
        links, a, b = np.zeros(len(ids), "i8"), [], []
        keys, weight, ts = np.frombuffer(b"".join(pdf["keys"]), "<i4").reshape(len(pdf), -1), pdf["n"].to_numpy("i8"), pdf["t"].to_numpy()
        own, lo, hi, vec = (pdf[c].to_numpy() for c in ("own", "lo", "hi", "vec"))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s < 2:
                continue
            same, part = lo[s] == hi[s], np.arange(s, e)
            p, q = (part, part) if same else (part[own[s:e] == lo[s]], part[own[s:e] == hi[s]])
            if not len(p) or not len(q):
                continue
            if len({len(vec[k]) for k in part}) > 1:  # a key of two lengths: they don't link
                continue
            x = vectors(vec[p], kind)
            y = x if same else vectors(vec[q], kind)
            i, j, first = cell_links(x, y, keys[p], keys[q], int(ts[s]), threshold, same)
            np.add.at(links, at[p[i[first]]], weight[q[j[first]]])
            np.add.at(links, at[q[j[first]]], weight[p[i[first]]])
            a.append(at[p[i]])
            b.append(at[q[j]])
        label = local_components(np.concatenate(a), np.concatenate(b), len(ids)) if a else np.arange(len(ids))
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[label[some]]})

    return dealt.groupBy("grp").applyInPandas(run, "cid bigint, links bigint, root bigint")


def embedding_components(df: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row a row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).withColumn("ok", usable(F.col("embedding")) & F.col("id").isNotNull())
    classes = rows.where("ok").groupBy("embedding").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    bits, tables = plan(n, threshold, miss)
    keyed = staged(sign_keys(classes, bits, tables, seed))
    found = staged(class_links(keyed, n, tables, threshold, NUMBER[df.schema[vec_col].dataType.elementType.simpleString()]))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    same_id = classes.join(classes.groupBy("low").agg(F.min("cid").alias("other"), F.count(F.lit(1)).alias("k")).where("k > 1"), "low").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    reached = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionAll(same_id))
    wide = classes.join(links, "cid", "left").join(reached, F.col("cid") == F.col("node"), "left").select("embedding", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("cc"))
    wide = staged(wide)
    lows = staged(wide.groupBy("cc").agg(F.min("low").alias("component")))  # written, so that adaptive execution may split the join
    wide = wide.join(lows, "cc").select(F.col("embedding").alias("v"), "n_links", "component")
    out = rows.where("ok").join(wide, F.col("embedding") == F.col("v")).select("id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
