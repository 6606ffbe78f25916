"""SimHash near-duplicates: 64-bit majority fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Texts of one fingerprint are one class. Two fingerprints that differ in at most `radius` of m bands' bits agree in at least
m - radius bands, so classes meet in the cells of those combinations of bands; a cell, or a block of a large one, is a
shard with a BK-tree of its own (children by integer Hamming distance to the parent), and a query follows only the edges
within the radius of its own distance. m grows with the number of classes, so cells stay small; it never changes what is
found. A shard's tree goes only to the tasks that hold its queries: its size is bounded by the block, whereas the trees of
all shards grow with the input and are not broadcast to all.

A null text has no words (fingerprint 0, linked like any other); a very long one is taken whole. Null ids belong to components but name none. Rows repeat as
they come. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import deal, grouped
from .common import component_lows, connected_components, local_components, map_arrow, popcount, staged, string_column

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints in a shard's tree at most.
SHARD = 4096


def fingerprints(raws: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """bytes.split() parts exactly at space and at 0x09 to 0x0D. A bit is set if it is in over half of the shingles' hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for r in raws:
        words = r.translate(LOWER).split()
        line = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        if len(words) <= size:
            hashes += [digest(line, seed)] if words else []
            counts.append(min(len(words), 1))
        else:
            begins = [0] + [e + 1 for e in ends[: len(words) - size]]
            hashes += [digest(line[a:b], seed) for a, b in zip(begins, ends[size - 1 :], strict=True)]
            counts.append(len(begins))
    out, n = np.zeros(len(raws), "u8"), np.array(counts)
    h, at = np.array(hashes, "u8"), np.concatenate([[0], np.cumsum(n)])
    live = np.flatnonzero(n)
    lo = 0
    while lo < len(live):  # some 65536 hashes at once, but for a longer text
        hi = max(lo + 1, int(np.searchsorted(at[live + 1], at[live[lo]] + 65536)))
        part = live[lo:hi]
        base = at[part[0]]
        bits = np.unpackbits(h[base : at[part[-1] + 1]].view("u1"), bitorder="little").reshape(-1, 64)
        ones = np.add.reduceat(bits, at[part] - base, axis=0, dtype="i4")
        out[part] = np.packbits(2 * ones > n[part][:, None], axis=1, bitorder="little").view("u8").ravel()
        lo = hi
    return out


class Forest:
    """BK-trees, one for each cell, built and searched level by level for all cells at once."""

    def __init__(self, x: np.ndarray, cell: np.ndarray, n_cells: int):
        self.x, self.root = x, np.full(n_cells, -1)
        rest, key, keys, children, level = np.arange(len(x)), cell.astype("i8"), [], [], 0
        while len(rest):
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            node = rest[first]
            if level:
                keys.append(key[first])
                children.append(node)
            else:
                self.root[key[first]] = node
            above = node[np.cumsum(first) - 1]
            rest, above = rest[~first], above[~first]
            key = above * 65 + popcount(x[rest] ^ x[above]).astype("i8")
            level += 1
        k = np.concatenate(keys) if keys else np.empty(0, "i8")
        order = np.argsort(k)
        self.keys, self.children = k[order], (np.concatenate(children) if children else np.empty(0, "i8"))[order]

    def within(self, q: np.ndarray, cell: np.ndarray, radius: int, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs at most radius apart, each query in its cell's tree."""
        a, b = [], []
        for lo in range(0, len(q), at_once):
            who = np.arange(lo, min(len(q), lo + at_once))
            node = self.root[cell[who]]
            who, node = who[node >= 0], node[node >= 0]
            while len(who):
                d = popcount(q[who] ^ self.x[node]).astype("i8")
                hit = d <= radius
                a.append(who[hit])
                b.append(node[hit])
                begin = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - begin
                who = np.repeat(who, n)
                node = self.children[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(who))]
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, "i8"), np.empty(0, "i8"))


def band_masks(n: int, radius: int, per_cell: int = 64) -> list[int]:
    """Masks of the bits that two fingerprints within the radius share in at least one case, for some per_cell in a cell."""
    m = radius + 1
    while (64 * (m - radius)) / m < np.log2(max(n, 2) / per_cell) and m < 2 * radius + 1:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    bands = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(m)]
    return [sum(c) for c in itertools.combinations(bands, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(classes: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints classes(fp) within the radius: each shard's spanning stars."""
    masks = band_masks(n, radius)
    keyed = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))).alias("c")).select("fp", "c.t", "c.key")
    dealt = grouped(deal(keyed, keyed.select("t", "key"), SHARD, "fp"), n * len(masks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy("i8").view("u8")
        cell, names = pd.factorize(pd.MultiIndex.from_frame(pdf[["t", "key", "lo", "hi"]]))
        in_tree = (pdf["own"] == pdf["lo"]).to_numpy()
        asks = (pdf["own"] == pdf["hi"]).to_numpy()
        tree, query = np.flatnonzero(in_tree), np.flatnonzero(asks)
        q, node = Forest(x[tree], cell[tree], len(names)).within(x[query], cell[query], radius)
        values, at = np.unique(x, return_inverse=True)
        label = local_components(at[query[q]], at[tree[node]], len(values))
        linked = np.flatnonzero(label != np.arange(len(values)))
        return pd.DataFrame({"a": values[linked].view("i8"), "b": values[label[linked]].view("i8")})

    return dealt.groupBy("grp").applyInPandas(run, "a bigint, b bigint")


def simhash_fingerprints(df: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): one pass, no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints([(t or "").encode() for t in b.column(1).to_pylist()], size)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("i8"))], ["id", "fp"])

    return map_arrow(df.select(df[id_col].alias("id"), string_column(df, text_col).alias("text")), run, f"id {id_type}, fp bigint").withColumnRenamed("id", id_col)


def simhash_components(df: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of fingerprints."""
    prints = staged(simhash_fingerprints(df, size, id_col, text_col))
    classes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    reached = connected_components(fingerprint_links(classes, classes.count(), radius))
    lows = component_lows(classes, reached, "fp").withColumnRenamed("low", "component_id")
    return prints.join(lows, "fp").select(id_col, "fp", "component_id")
