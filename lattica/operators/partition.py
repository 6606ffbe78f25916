"""Graph partitioners: hash, longest-processing-time, linear deterministic greedy; relabelling, thresholds, edge cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, with_row_index
from .graph import Graph


def hash_partition(nodes: DataFrame, parts: int) -> DataFrame:
    """(node, part): the node's non-negative remainder."""
    return nodes.select("node", F.pmod("node", F.lit(parts)).cast("int").alias("part"))


def _slots_up_to(loads: np.ndarray, size: int, level: np.ndarray) -> np.ndarray:
    """Per level, the slots (load + k size, k >= 0) of each bin that are at most the level."""
    return np.maximum((level[:, None] - loads[None, :]) // size + 1, 0)


def greedy_bins(loads: np.ndarray, size: int, ranks: np.ndarray) -> np.ndarray:
    """The bin of the r-th of equal jobs, each put to the first bin of least load: the r-th smallest slot, by bisection."""
    lo = np.full(len(ranks), loads.min())
    hi = np.full(len(ranks), loads.max() + size * (int(ranks.max(initial=0)) + 1))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = _slots_up_to(loads, size, mid).sum(1) > ranks
        hi, lo = np.where(enough, mid, hi), np.where(enough, lo, mid + 1)
    before = _slots_up_to(loads, size, lo - 1).sum(1)
    at_level = (_slots_up_to(loads, size, lo) - _slots_up_to(loads, size, lo - 1)).cumsum(1)
    return (at_level > (ranks - before)[:, None]).argmax(1)


def lpt_partition(degrees: DataFrame, parts: int) -> DataFrame:
    """(node, degree, part, pos): nodes by descending degree, then id, each to the first bin of least load.

    Nodes of one degree are interchangeable, so the loads follow from the histogram of degrees alone (at most about the
    square root of twice the edges), and each node's bin from its rank in its class; the rank is a distributed row index.
    """
    ranked = cut(with_row_index(degrees.select("node", "degree"), F.desc("degree"), F.asc("node"), name="rank"))
    classes = ranked.groupBy("degree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("degree")).collect()
    loads, table = np.zeros(parts, "i8"), {}
    for c in classes:
        table[c.degree] = (c.first, loads.copy())
        bins = greedy_counts(loads, c.degree, c.n)
        loads = loads + bins * c.degree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            degree, rank = (b.column(k).to_numpy() for k in (1, 2))
            part = np.zeros(len(degree), "i4")
            for d in np.unique(degree):
                first, at = table[int(d)]
                own = degree == d
                part[own] = greedy_bins(at, int(d), rank[own] - first)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part), b.column(2)], ["node", "degree", "part", "pos"])

    rows = ranked.select(F.col("node").cast("bigint").alias("node"), F.col("degree").cast("bigint").alias("degree"), F.col("rank").cast("bigint").alias("rank"))
    return rows.mapInArrow(run, "node bigint, degree bigint, part int, pos bigint")


def greedy_counts(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of n equal jobs each bin gets."""
    if n == 0:
        return np.zeros(len(loads), "i8")
    lo, hi = int(loads.min()), int(loads.max() + size * n)
    while lo < hi:  # smallest level with at least n slots
        mid = (lo + hi) // 2
        if _slots_up_to(loads, size, np.array([mid])).sum() >= n:
            hi = mid
        else:
            lo = mid + 1
    below = _slots_up_to(loads, size, np.array([lo - 1]))[0]
    extra = np.flatnonzero(_slots_up_to(loads, size, np.array([lo]))[0] - below)[: n - int(below.sum())]
    below[extra] += 1
    return below


def ldg_partition(graph: Graph, parts: int, n_edges: int | None = None) -> DataFrame:
    """(node, degree, part, pos): nodes stream in ascending id, each to the first part of highest score.

    Capacity C is int(edges / parts + 1) * 2; a part with c - 1 of the node's neighbours and weight w = 1 - (load +
    degree) / C scores c * w, or 0 if w is not positive and c > 1, or w if c is 1; a repeated neighbour counts as often. The order of the stream decides the result, so
    the state is one process's: neighbour lists pass through the driver one at a time, and it keeps node and part only.
    """
    spark = graph.edges.sparkSession
    capacity = int((graph.num_edges() if n_edges is None else n_edges) / parts + 1) * 2
    part_of: dict[int, int] = {}
    loads, rows = [0] * parts, []
    for r in graph.neighbors().orderBy("node").toLocalIterator(prefetchPartitions=True):
        shared = [0] * parts
        for v in r.nbrs:
            if v in part_of:
                shared[part_of[v]] += 1
        d, best, score = len(r.nbrs), 0, float("-inf")
        for p in range(parts):
            c, w = 1 + shared[p], 1 - (loads[p] + d) / capacity
            s = c * w if w > 0 else (1 // c) * w
            if s > score:
                best, score = p, s
        part_of[r.node] = best
        loads[best] += d
        rows.append((r.node, d, best, r.node))
    return spark.createDataFrame(rows, "node bigint, degree bigint, part int, pos bigint")


def relabel(assigned: DataFrame) -> DataFrame:
    """(node, id): ids from 0, contiguous in each part, in the order of pos."""
    return with_row_index(assigned.select("node", "part", "pos"), F.asc("part"), F.asc("pos"), F.asc("node"), name="id").select("node", "id")


def thresholds(assigned: DataFrame, parts: int) -> DataFrame:
    """(part, start): exclusive prefix sums of part sizes; one row a part."""
    sizes = assigned.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    all_parts = assigned.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    filled = all_parts.join(sizes, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return filled.select("part", F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))


def lower_bound(a: list[int], x: int) -> int:
    """Greatest index with a[i] <= x, of equal ones the last; -1 below all."""
    import bisect

    return bisect.bisect_right(a, x) - 1


def locate(ids: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, part): the last part whose start is at most the id, found in a literal array; starts has a row a part. No join, no shuffle."""
    at = [(r.start, r.part) for r in starts.select("start", "part").orderBy("start", "part").collect()]
    if not at:
        return ids.select("id", F.lit(None).cast("int").alias("part")).limit(0)
    begin, part = F.array(*(F.lit(s) for s, _ in at)), F.array(*(F.lit(p) for _, p in at))
    place = F.size(F.filter(begin, lambda s: s <= F.col("id")))
    return ids.select("id", F.when(place > 0, F.element_at(part, place)).alias("part")).where("part IS NOT NULL")


def edge_cut(graph: Graph, assigned: DataFrame) -> DataFrame:
    """(n_edges, n_cut, cut_rate); an edge with an unassigned endpoint counts as an edge only."""
    a = assigned.select(F.col("node").alias("src"), F.col("part").alias("pu"))
    b = assigned.select(F.col("node").alias("dst"), F.col("part").alias("pv"))
    e = graph.edge_list().join(a, "src", "left").join(b, "dst", "left")
    cut_edges = F.coalesce(F.sum(F.when(F.col("pu") != F.col("pv"), 1).otherwise(0)), F.lit(0)).cast("bigint")
    return e.agg(F.count(F.lit(1)).alias("n_edges"), cut_edges.alias("n_cut")).select("n_edges", "n_cut", F.coalesce(F.try_divide(F.col("n_cut").cast("double"), F.col("n_edges")), F.lit(0.0)).alias("cut_rate"))
