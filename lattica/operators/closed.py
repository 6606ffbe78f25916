"""The product of a pattern with itself under its own mask: for each entry (i, j), how many k have entries (i, k) and (k, j).

The paths i, k, j outnumber the entries by far, so they never become rows. Entries are sorted into blocks of consecutive rows; a block
holds its entries as mask and left factor, gets the packed rows k that these name, a row once for a block, and counts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import release, staged

#: Entries in a unit, which blocks are made of, and in a block at most; columns of right rows that are counted at once, about.
UNIT, BLOCK, CHUNK = 1 << 18, 1 << 21, 1 << 20
#: A right row that is so many times longer than the mask's is searched for the mask's columns, not read.
LONG = 64
_PACKED = "i bigint, base bigint, n int, gaps binary"


def _pack(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (i, j), duplicates among them, to (unit, i, base, n, gaps): the first column and the steps to the next ones."""
    from pyspark import TaskContext

    unit, last = TaskContext.get().partitionId() << 32, None

    def unit_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nonlocal unit, last
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.append((i[0], j[0]) != last, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        last = i[-1], j[-1]
        i, j = i[new], j[new]
        if len(i):
            begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            gaps, ends = np.diff(j, prepend=0), np.append(begin[1:], len(i))
            gaps[begin] = 0
            bits = np.searchsorted([1 << 8, 1 << 16, 1 << 32], np.maximum.reduceat(gaps.view("u8"), begin), "right")
            cells = [gaps[a:b].astype(t).tobytes() for a, b, t in zip(begin.tolist(), ends.tolist(), np.array(["<u1", "<u2", "<u4", "<u8"])[bits].tolist(), strict=True)]
            for a in range(0, len(begin), 4096):
                at = begin[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), unit)), pa.array(i[at]), pa.array(j[at]), pa.array((ends[a : a + 4096] - at).astype("i4")), pa.array(cells[a : a + 4096], pa.binary())], ["unit", "i", "base", "n", "gaps"])
            unit += 1

    parts, held = [], 0
    for b in batches:
        i, j = (b.column(c).to_numpy() for c in (0, 1))
        for a in range(0, len(i), size):
            parts.append((i[a : a + size], j[a : a + size]))
            held += len(parts[-1][0])
            if held >= size:
                yield from unit_of(parts)
                parts, held = [], 0
    if parts:
        yield from unit_of(parts)


def _columns(base: np.ndarray, n: np.ndarray, gaps: list[bytes]) -> np.ndarray:
    """The packed rows' columns, one row after the other."""
    if not len(n):
        return np.zeros(0, "i8")
    steps = np.concatenate([np.frombuffer(g, f"<u{len(g) // k}") for g, k in zip(gaps, n.tolist(), strict=True)]).astype("i8")
    whole, begin = np.cumsum(steps), np.cumsum(n) - n
    return whole + np.repeat(base - whole[begin], n)


def _unpacked(b: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of a batch's given rows."""
    i, base, n = (b.column(c).to_numpy()[rows] for c in ("i", "base", "n"))
    return np.repeat(i, n), _columns(base, n.astype("i8"), b.column("gaps").take(pa.array(rows)).to_pylist())


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, k): the columns of a batch's rows, once for each block."""
    for b in batches:
        block = b.column("block").to_numpy()
        for x in np.unique(block).tolist():
            k = np.unique(_unpacked(b, np.flatnonzero(block == x))[1])
            for a in range(0, len(k), 1 << 16):
                own = k[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x, "i4")), pa.array(own)], ["block", "k"])


class _Block:
    """One block's mask and left factor, and its counts."""

    def __init__(self, mask: list, more: list, long: int) -> None:
        self.long = long
        self.i, self.j = (np.concatenate(x) for x in zip(*mask, strict=True))
        self.rows, begin = np.unique(self.i, return_index=True)
        self.begin = np.append(begin, len(self.i))
        self.names, at = np.unique(self.j, return_inverse=True)
        self.at, self.counts = at.astype("i4"), np.zeros(len(self.i), "i8")
        left_i, left_k = (np.concatenate(x) for x in zip((self.i, self.j), *more, strict=True))
        order = np.argsort(left_k, kind="stable")
        self.left_k, self.left_row = left_k[order], np.searchsorted(self.rows, left_i[order]).astype("i4")
        self.place, self.range = np.zeros(len(self.names), "i4"), np.arange(1 << 16)

    def add(self, right: list) -> None:
        """Counts the paths through these right rows, which are sorted."""
        k, cols = (np.concatenate(x) for x in zip(*right, strict=True))
        at = np.minimum(np.searchsorted(self.names, cols), len(self.names) - 1)
        known = self.names[at] == cols
        k, at = k[known], at[known]
        if not len(k):
            return
        ks, begin = np.unique(k, return_index=True)
        begin = np.append(begin, len(k))
        a, b = np.searchsorted(self.left_k, ks[0]), np.searchsorted(self.left_k, ks[-1], "right")
        place = np.searchsorted(ks, self.left_k[a:b])
        met = ks[place] == self.left_k[a:b]
        row, place = self.left_row[a:b][met], place[met]
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        start, size = begin[place], np.diff(begin)[place]
        cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for r, x, y in zip(row[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
            lo, hi = self.begin[r], self.begin[r + 1]
            own, s, z = self.at[lo:hi], start[x:y], size[x:y]
            if z.max() > self.long * (hi - lo):
                far = z > self.long * (hi - lo)
                for p, q in zip(s[far].tolist(), z[far].tolist(), strict=True):
                    found = at[p : p + q]
                    self.counts[lo:hi] += found[np.minimum(np.searchsorted(found, own), q - 1)] == own
                s, z = s[~far], z[~far]
            end = np.cumsum(z)
            if not len(end):
                continue
            if end[-1] > len(self.range):
                self.range = np.arange(2 * end[-1])
            cells = at[np.repeat(s - end + z, z) + self.range[: end[-1]]]
            self.place[own] = np.arange(1, hi - lo + 1)
            self.counts[lo:hi] += np.bincount(self.place[cells], minlength=hi - lo + 1)[1:]
            self.place[own] = 0

    def found(self) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.counts)
        for a in range(0, len(at), 1 << 16):
            own = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (self.i, self.j, self.counts)], ["i", "j", "v"])


def _count(chunk: int, long: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's rows, sorted by kind, i and base: 0 the mask, 1 parts of its rows that lie in other blocks, 2 right rows."""
    left, block, right, held = ([], []), None, [], 0
    for b in batches:
        kind, n = b.column("kind").to_numpy(), b.column("n").to_numpy()
        for x in (0, 1):
            if len(at := np.flatnonzero(kind == x)):
                left[x].append(_unpacked(b, at))
        at = np.flatnonzero(kind == 2)
        if len(at) and block is None:
            block, left = _Block(*left, long), None
        ends = np.cumsum(n[at], dtype="i8")
        for part in np.split(at, np.flatnonzero(np.diff(ends // chunk)) + 1) if len(at) else ():
            right.append(_unpacked(b, part))
            held += len(right[-1][0])
            if held >= chunk:
                block.add(right)
                right, held = [], 0
    if right:
        block.add(right)
    if block:
        yield from block.found()


def _blocks(units: list, most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(unit, block), consecutive units of at most `most` entries together; (i, block) of the rows that lie in several blocks."""
    of, block, held, where = [], 0, 0, {}
    for u in units:
        if held and held + u.n > most:
            block, held = block + 1, 0
        held += u.n
        of.append((u.unit, block))
        for i in {u.lo, u.hi}:
            where.setdefault(i, set()).add(block)
    return of, [(i, x) for i, own in where.items() if len(own) > 1 for x in sorted(own)]


def closed_paths(entries: DataFrame, unit: int = UNIT, block: int = BLOCK, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """(i, j, v bigint) for entries(i, j), of which duplicates count once: each that has a k, with their number.

    The driver gets a row for each unit of entries. A right row goes to the blocks that hold a row which names it: to few if the ids of
    near nodes are near, to each block at most. A single row has to fit a worker.
    """
    spark = entries.sparkSession
    order = entries.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).repartitionByRange("i", "j").sortWithinPartitions("i", "j")
    rows = staged(order.mapInArrow(partial(_pack, unit), f"unit bigint, {_PACKED}"))
    units = rows.groupBy("unit").agg(F.sum("n").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).orderBy("unit").collect()
    release(spark)
    most = min(block, max(unit, sum(u.n for u in units) // (2 * spark.sparkContext.defaultParallelism)))
    of, shared = _blocks(units, most)
    packed = ["i", "base", "n", "gaps"]
    placed = rows.join(F.broadcast(spark.createDataFrame(of, "unit bigint, block int")), "unit").select("block", F.lit(0).alias("kind"), *packed)
    left = placed
    if shared:
        elsewhere = placed.withColumnRenamed("block", "home").join(F.broadcast(spark.createDataFrame(shared, "i bigint, block int")), "i").where("home <> block")
        left = left.unionByName(elsewhere.select("block", F.lit(1).alias("kind"), *packed))
    named = left.mapInArrow(_named, "block int, k bigint").distinct()
    right = rows.join(named, F.col("i") == F.col("k")).select("block", F.lit(2).alias("kind"), *packed)
    met = left.unionByName(right).repartitionById(max(1, of[-1][1] + 1 if of else 0), "block").sortWithinPartitions("kind", "i", "base")
    return met.mapInArrow(partial(_count, chunk, long), "i bigint, j bigint, v bigint")
