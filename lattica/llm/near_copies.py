"""Near copies by content: texts whose sets of word shingles have a Jaccard similarity of at least LEAST are linked.

Candidates come from two sides. SimHash, the operator of simhash.py, links fingerprints within a few bits by its BK-trees; at this
similarity about 10 of 64 bits differ, give or take 3, so it finds the closest copies only. MinHash reaches the others: BANDS keys of ROWS
minima each, so that a pair at the threshold meets in no cell with probability (1 - 0.8^7)^50 < 1e-5. Both only say which texts may
be linked at all. Texts that they connect are a candidate group, and inside it every pair is decided by the exact similarity
of the sets (of 64-bit hashes); a group of more than SHARD is dealt in blocks that meet pairwise, so no pair of it is lost.

Texts of one set are one class. Words part at space and at 0x09 to 0x0D, and ASCII letters are lowered; a text of fewer words
than a shingle is a shingle of its own, and texts without words are alike; very long texts are taken whole. Null ids belong to
components but name none. Rows repeat as they come. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import deal, grouped
from .common import bitmap, component_lows, connected_components, discard, in_bitmap, kept_rows, map_arrow, staged, staged_at, string_column
from .simhash import LOWER, fingerprint_links, fingerprints

#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 50, 7
#: Classes in a block of a candidate group at most.
SHARD = 1024
#: Bits within which SimHash links candidates.
RADIUS = 4

_random = np.random.default_rng(42)
_WORD = _random.integers(0, 1 << 64, 64, "u8") | np.uint64(1)
_MINIMA = _random.integers(0, 1 << 32, BANDS * ROWS, "u4") | np.uint32(1)
_KEY = _random.integers(0, 1 << 64, (BANDS, ROWS), "u8") | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of xxHash: every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """The distinct hashes of its shingles in order; never empty."""
    words = raw.translate(LOWER).split()
    w = np.array([xxhash.xxh64_intdigest(x) for x in words], "u8")
    if len(w) < size:
        return _mixed(np.array([np.sum(w * _WORD[: len(w)], dtype="u8") + np.uint64(len(w))], "u8"))
    n = len(w) - size + 1
    h = np.full(n, size, "u8")
    for k in range(size):
        h += w[k : k + n] * _WORD[k]
    return np.unique(_mixed(h))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; the key of a band says which band it is."""
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype("u4")
    low = np.empty((BANDS * ROWS, len(sets)), "u4")
    for k, a in enumerate(_MINIMA):
        np.minimum.reduceat(x * a, begins, out=low[k])
    rows = low.reshape(BANDS, ROWS, -1).astype("u8")
    keys = (rows * _KEY[:, :, None]).sum(1, dtype="u8") + np.arange(BANDS, dtype="u8")[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return np.ascontiguousarray(_mixed(keys).T)


def exact_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the components of all pairs at least LEAST alike: each set in turn meets all that are not reached."""
    part, whole = LEAST
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    _, name = np.unique(flat, return_inverse=True)
    begin = np.cumsum(n) - n
    a, b, rest, marked = [], [], np.argsort(n, kind="stable"), np.zeros(name.max() + 1, bool)
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            u = reached.pop()
            own = name[begin[u] : begin[u] + n[u]]
            marked[own] = True
            fits = (whole * n[rest] >= part * n[u]) & (whole * n[u] >= part * n[rest])
            hit = np.zeros(len(rest), bool)
            if fits.any():
                who = rest[fits]
                start = np.cumsum(n[who]) - n[who]
                at = np.repeat(begin[who] - start, n[who]) + np.arange(n[who].sum())
                both = np.add.reduceat(marked[name[at]], start, dtype="i8")
                hit[fits] = (whole + part) * both >= part * (n[u] + n[who])
            marked[own] = False
            found = rest[hit]
            a += [u] * len(found)
            b += found.tolist()
            reached += found.tolist()
            rest = rest[~hit]
    return np.array(a, "i8"), np.array(b, "i8")


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """(id, row, txt, cls, fp, keys) of rows(id, row, text): one pass, no shuffle; txt is a hash of the text, cls of its set."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raws = [t.encode() for t in b.column(3).to_pylist()]
        sets = [shingle_set(t, size) for t in raws]
        cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "u8").view("i8")
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype="i4")), pa.array(band_keys(sets).ravel().view("i8")))
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cls), pa.array(fingerprints(raws, size).view("i8")), keys], ["id", "row", "txt", "cls", "fp", "keys"])

    return map_arrow(rows.select("id", "row", F.xxhash64("text").alias("txt"), "text"), run, f"id {id_type}, row bigint, txt bigint, cls bigint, fp bigint, keys array<bigint>")


def _candidates(sketches: DataFrame) -> DataFrame:
    """(cls, key): the classes that share a cell with another or are linked by SimHash, by the group that these connect.

    A bitmap of the shared keys sorts out most others before the join; those it lets through by chance fall out there.
    """
    cells = sketches.select("cls", F.explode("keys").alias("key")).groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("last"))
    shared = staged(cells.where("lead < last").select("key", "lead"))
    bits = sketches.sparkSession.sparkContext.broadcast(bitmap(shared, "key"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b.column(1).flatten().to_numpy()
        hit = np.flatnonzero(in_bitmap(bits.value, keys))
        return pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[hit // BANDS]), pa.array(keys[hit])], ["cls", "key"])

    keyed = map_arrow(sketches.select("cls", "keys"), run, "cls bigint, key bigint").distinct()
    edges = keyed.join(shared, "key").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    prints = staged(sketches.select("fp", "cls").distinct())
    leads = staged(prints.groupBy("fp").agg(F.min("cls").alias("lead")))
    same = prints.join(leads, "fp").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    close = fingerprint_links(leads.select("fp"), leads.count(), RADIUS)
    named = close.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return connected_components(edges.unionAll(same).unionAll(named)).select(F.col("node").alias("cls"), F.col("component").alias("key"))


def _links(rows: DataFrame, sketches: DataFrame, size: int) -> DataFrame:
    """Edges (a, b) of classes that are near copies, enough to connect each component. The sets of candidates are made anew."""
    found = staged(_candidates(sketches))
    sc = sketches.sparkSession.sparkContext
    classes = sc.broadcast(bitmap(found, "cls"))
    likely = map_arrow(sketches.select("txt", "cls"), lambda b: b.filter(pa.array(in_bitmap(classes.value, b.column(1).to_numpy()))), "txt bigint, cls bigint")
    bits = sc.broadcast(bitmap(likely, "txt"))

    def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
        hit = np.flatnonzero(in_bitmap(bits.value, b.column(0).to_numpy()))
        raw = [shingle_set(t.encode(), size).tobytes() for t in b.column(1).take(pa.array(hit)).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(r) for r in raw], "u8").view("i8")), pa.array(raw, pa.binary())], ["cls", "shingles"])

    again = map_arrow(rows.select(F.xxhash64("text").alias("txt"), "text"), sets_of, "cls bigint, shingles binary")
    sets = again.join(found, "cls").dropDuplicates(["cls"]).withColumn("t", F.lit(0))
    dealt = grouped(deal(sets, found.select(F.lit(0).alias("t"), "key"), SHARD, "cls"), found.count(), 2000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, cell in pdf.groupby(["t", "key", "lo", "hi"]):
            cls = cell["cls"].to_numpy("i8")
            x, y = exact_links([np.frombuffer(s, "u8") for s in cell["shingles"]])
            a.append(cls[x])
            b.append(cls[y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("grp").applyInPandas(run, "a bigint, b bigint")


def _grouped_rows(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, low) of every row, row being a hash of all its columns: low is the first (nulls last) id and row of its component."""
    rows = df.select(df[id_col].alias("id"), F.xxhash64(*(df[c] for c in df.columns)).alias("row"), string_column(df, text_col).alias("text"))
    sketches, path = staged_at(_sketches(rows, size))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = staged(sketches.groupBy("cls").agg(F.min(order).alias("low")))
    reached = connected_components(_links(rows, sketches, size))
    lows = component_lows(classes, reached, "cls")
    out = staged(sketches.select("id", "row", "cls").join(lows, "cls").select("id", "row", "low"))
    discard(path)
    return out


def near_copy_components(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): component_id is the smallest id reachable over near copies."""
    return _grouped_rows(df, size, id_col, text_col).select(F.col("id").alias(id_col), F.col("low.id").alias("component_id"))


def first_of_copies(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null ids last), of equal ids that of the smallest
    hash of all columns, of rows equal in everything any. Columns are of types that xxhash64 takes. Texts stay where they lie, see kept_rows().
    """
    told = _grouped_rows(df, size, id_col, text_col)
    first = ~F.col("id").eqNullSafe(F.col("low.id")) | (F.col("row") != F.col("low.row"))
    counted = told.groupBy("row", "id", first.alias("gone")).agg(F.count(F.lit(1)).alias("n"))
    decided = staged(counted.select("row", "id", "gone", (~F.col("gone") & (F.col("n") > 1)).alias("repeated")))
    named = df.select("*", F.xxhash64(*(df[c] for c in df.columns)).alias("__row"), df[id_col].alias("__id"))
    out = kept_rows(named, decided.select(F.col("row").alias("__row"), F.col("id").alias("__id"), "gone", "repeated"), ["__row", "__id"])
    return out.select(*(F.col(f"`{c}`") for c in df.columns))
