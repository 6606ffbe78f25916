"""Removes byte strings that also start in a document of smaller id, by merging Burrows-Wheeler transforms of shards.

1. Texts are written as shards. A window of `SPAN` bytes is keyed by the least hash of its K-byte grams; consecutive windows
   of one key are a run. Keys of one shard, 6 bytes each, go to buckets; a key that only one document has can hold no
   repeat. Answers go back as two bits a key: whether it may, and whether it is hot.
2. Runs of the remaining keys are collapsed by their bytes within a shard and go to the buckets of their keys: equal windows
   have equal keys, so all that may repeat meets there. A hot key has too many different runs for one bucket; its windows
   are runs of their own, keyed by all their bytes, which spreads them over all buckets. A wide key stands in so many shards that
   even its equal runs would fill a bucket: they first meet in groups of shards, about the square root of all each, where equal
   ones are collapsed to the smallest document, and only then in the bucket; the answer goes back the same way.
3. In a bucket the runs are cut into slices, each slice's runs are dealt to at most four strings of a collection, the rotations of each
   are sorted once by prefix doubling, and from then on only its Burrows-Wheeler transform is used: the interleave of all four is
   refined by stable sorts of the transform's symbols, LF steps of 2 and then six times 8 bytes, until it is in order by 50 bytes.
   Boundaries that appear at a pass give the common prefix's depth; what has no boundary at depth 50 is a repeated interval.
   Each interval's smallest document is taken, and the windows whose own document is larger are sent back to their shard, as bits.
4. Each shard marks, joins and cuts its bytes.

So hashing of windows finds what may repeat and brings it together, at a few bytes a key, and the merge of transforms decides what does:
refining the interleave of whole shards costs dozens of passes over all bytes. In a merge the suffixes of different transforms are
not compared or sorted anew; a pass sorts symbols. No task holds more than a shard, a bucket's runs, or a slice of them.

A null text is empty; texts under 50 bytes have no windows; a text of any length lies in one shard. Rows of equal ids are no smaller
than each other; a null id is larger than any other; ids are cast to bigint, and one that is no number raises. An empty table gives an
empty result. Other columns can be carried through, under any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get, put, release, shared_dir, staged, string_column, trim, tune

SPAN, K = 50, 24
WIDE = SPAN - K + 1
#: Bytes of text in a shard, and of text whose keys go to one bucket, about; windows in a run; bytes of runs in one merge.
SHARD_BYTES, BUCKET_BYTES, RUN, SLICE = 4 << 20, 6 << 20, 32, 320 << 10
CONTENT = RUN + SPAN - 1
#: Different runs of one key, about, beyond which its windows go out one by one, by their own bytes.
HOT_RUNS = 20_000
#: Shards in which a key may stand before its runs are combined by groups of shards.
WIDE_SHARDS = 64
LAST = np.iinfo("i8").max


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """48-bit hashes of the K bytes from each place on; 0 where fewer are left."""
    n = len(text) - K + 1
    if n < 1:
        return np.zeros(0, "u8")
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(29)
        h += words[at : at + n]
        h *= np.uint64(c)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(16)


def window_keys(text: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """The least hash of the grams of each window of SPAN bytes; windows in blocks, so that only the result is as long as the text."""
    out = np.empty(max(len(text) - SPAN + 1, 0), "u8")
    for lo in range(0, len(out), at_once):
        h, width = gram_hashes(text[lo : lo + at_once + SPAN - 1]), 1
        while width < WIDE:
            step = min(width, WIDE - width)
            h = np.minimum(h[:-step], h[step:])
            width += step
        out[lo : lo + at_once] = h
    return out


def runs_of(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key, document) of runs of equal keys inside documents; bounds has the documents' ends, 0 first."""
    key = window_keys(text)
    n = len(key)
    if not n:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8")
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first, last = bounds[:-1], np.maximum(bounds[1:] - SPAN + 1, bounds[:-1])
    new[first[first < n]] = True
    new[last[last < n]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start < last[doc]
    return start[inside], length[inside], key[start[inside]], doc[inside]


def cut_runs(start: np.ndarray, length: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in pieces of at most so many windows: (start, windows, index of the run)."""
    n = -(-length // most)
    which = np.repeat(np.arange(len(start)), n)
    at = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * most[which]
    return start[which] + at, np.minimum(length[which] - at, most[which]), which


def run_counts(text: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, n_keys: int) -> np.ndarray:
    """Logarithms (base 2, up) of how many runs each key has that differ in their first or last 8 bytes; 0 for one."""
    if not len(start):
        return np.zeros(n_keys, "u1")
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    ends = (words[start] * np.uint64(0x9E3779B97F4A7C15)) ^ words[start + length + SPAN - 9]
    pair = np.unique((at.astype("u8") << np.uint64(40)) | ((ends * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)))
    return np.ceil(np.log2(np.maximum(np.bincount((pair >> np.uint64(40)).astype("i8"), minlength=n_keys), 1))).astype("u1")


def content_keys(content: np.ndarray) -> np.ndarray:
    """48-bit hashes of whole rows."""
    words, h = content.view("<u8"), np.zeros(len(content), "u8")
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(16)


def collapse(content: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, index of each row's): equal rows of content (padded to whole words) and size; compared in full."""
    words = content.view("<u8")
    h = size.astype("u8")
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    w, s = words[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]).any(1) | (s[1:] != s[:-1])
    inverse = np.empty(len(order), "i8")
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def gathered(text: np.ndarray, start: np.ndarray, size: np.ndarray, at_once: int = 16384) -> np.ndarray:
    """The strings of text from start on as rows, padded with 0 to whole words."""
    out = np.zeros((len(start), -(-CONTENT // 8) * 8), "u1")
    column = np.arange(out.shape[1])
    for lo in range(0, len(start), at_once):
        s = slice(lo, lo + at_once)
        inside = column < size[s, None]
        out[s][inside] = text[(start[s, None] + column)[inside]]
    return out


def rows_of(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings one after another as rows, padded with 0 to whole words."""
    out = np.zeros((len(size), -(-CONTENT // 8) * 8), "u1")
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


# merging


def sorted_keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their stable order), for keys below 2**bits: where place and key fit into one word, a sort of words."""
    low = max(len(key) - 1, 1).bit_length()
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    x = (key.astype("u8", copy=False) << np.uint64(low)) | np.arange(len(key), dtype="u8")
    x.sort()
    return x >> np.uint64(low), (x & np.uint64((1 << low) - 1)).astype("i4" if low < 32 else "i8")


def ranks(key: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks, equal for equal keys."""
    y, order = sorted_keys(key, bits)
    new = np.zeros(len(y), bool)
    np.not_equal(y[1:], y[:-1], out=new[1:])
    out = np.empty(len(y), "u4")
    out[order] = np.cumsum(new, dtype="u4")
    return out


def pairs(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return (high.astype("u8") << np.uint64(bits)) | low


class Rotations:
    """All rotations of some strings, laid end to end; symbols are 8 bytes wide, as ranks among all shards."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        whole = "i4" if len(flat) < 1 << 31 else "i8"
        self.begin = np.cumsum(size) - size
        self.base, self.size = np.repeat(self.begin.astype(whole), size), np.repeat(size.astype(whole), size)
        self.at = np.arange(len(flat), dtype=whole) - self.base
        self.bits = max(len(flat), 1).bit_length()
        b = flat.astype("u4")
        self.two = (b << np.uint32(8)) | b[self.after(1)]
        four = ranks(pairs(self.two, self.two[self.after(2)], 16), 32)
        self.eight = ranks(pairs(four, four[self.after(4)], self.bits), 2 * self.bits)

    def after(self, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The place n bytes on, in the rotation of each place from lo to hi; n is less than a string is long."""
        at, size = self.at[lo:hi] + n, self.size[lo:hi]
        at += size * (at < 0) - size * (at >= size)
        at += self.base[lo:hi]
        return at

    def transform(self, lo: int, hi: int) -> np.ndarray:
        """The order of the rotations from lo to hi, a shard's whole strings, by 64 bytes: its suffix array."""
        r, width = self.eight[lo:hi], 8
        while True:
            key = pairs(r, r[self.after(width, lo, hi) - lo], self.bits)
            if width == 32:
                return lo + sorted_keys(key, 2 * self.bits)[1]
            r, width = ranks(key, 2 * self.bits), 2 * width


def refine(z: np.ndarray, block: np.ndarray, bwt: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass: z names each place's shard, block its interval so far; bwt has the shards' transforms one after another.

    The k-th place of a shard reads the k-th symbol of its transform; places go, stably, to the order of their symbols. A
    boundary between two places is new if their symbols differ, old if they came from different intervals.
    """
    symbol = np.empty(len(bwt), "u8")
    symbol[np.argsort(z, kind="stable")] = bwt
    s, order = sorted_keys(symbol, bits)
    b = block[order]
    new = s[1:] != s[:-1]
    new |= b[1:] != b[:-1]
    out = np.zeros(len(s), block.dtype)
    np.cumsum(new, out=out[1:])
    return z[order], out


def merged_intervals(flat: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """For each place of the strings, its interval: places of one interval, and only they, begin the same SPAN bytes (cyclic)."""
    rot = Rotations(flat, size)
    cuts = np.append(rot.begin, len(flat))[np.linspace(0, len(size), shards + 1).astype(int)]
    order = np.concatenate([rot.transform(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    z = np.repeat(np.arange(shards, dtype="u1"), np.diff(cuts))
    block = np.zeros(len(flat), rot.at.dtype)
    z, block = refine(z, block, rot.two[rot.after(-2)[order]], 16)
    bwt = rot.eight[rot.after(-8)[order]]
    for _ in range((SPAN - 2) // 8):
        z, block = refine(z, block, bwt, rot.bits)
    out = np.empty(len(flat), block.dtype)
    out[order] = block[np.argsort(z, kind="stable")]
    return out


def smaller_elsewhere(content: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Bits, for each run, of the windows that also start in a run of a smaller document."""
    first, same = collapse(content, size)
    low = np.full(len(first), LAST)
    np.minimum.at(low, same, doc)
    order = np.argsort(key[first], kind="stable")  # slices hold whole keys
    first, low, back = first[order], low[order], np.empty(len(order), "i8")
    back[order] = np.arange(len(order))
    same = back[same]
    total = np.cumsum(size[first])
    least = np.full((len(first), RUN), LAST)
    begin = 0
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SLICE)))
        while end < len(first) and key[first[end]] == key[first[end - 1]]:
            end += 1
        part = first[begin:end]
        n = size[part]
        flat = content[part][np.arange(content.shape[1]) < n[:, None]]
        interval = merged_intervals(flat, n, min(len(part), 4))
        place = np.concatenate([[0], np.cumsum(n)[:-1]])[:, None] + np.arange(RUN)
        real = np.arange(RUN) < (n - SPAN + 1)[:, None]
        of = interval[place[real]]
        low_of = np.full(int(interval.max()) + 1, LAST)
        np.minimum.at(low_of, of, np.repeat(low[begin:end], n - SPAN + 1))
        least[begin:end][real] = low_of[of]
        begin = end
    return ((least[same] < doc[:, None]).astype("u8") << np.arange(RUN, dtype="u8")).sum(1).astype("<u4")


# shards and buckets


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def _shard(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, ids) of a shard's table."""
    column = t.column("__text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, "i8", len(column) + 1, column.offset * 8)
    text = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    ids = t.column("__id").fill_null(LAST).to_numpy()
    return text[bounds[0] : bounds[-1]], bounds - bounds[0], ids


def _by_cell(cell: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by their cell, the cells that have any, and their bounds in that order.

    Only these send and get rows, so rows follow the text, not shards x buckets. A shard without rows has one empty cell.
    """
    if not len(cell):
        return np.zeros(0, "i8"), np.array([empty]), np.zeros(2, "i8")
    order = np.argsort(cell, kind="stable")
    names, first = np.unique(cell[order], return_index=True)
    return order, names, np.append(first, len(cell))


def _runs_table(shard: int, names: np.ndarray, pieces: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of the runs that a shard, or a group of them, sends to cells: bytes of content, windows, documents, keys."""
    return pa.table({
        "shard": pa.array([shard] * len(names), pa.int64()), "cell": pa.array(names, pa.int64()), "bits": pa.array([None] * len(names), pa.binary()),
        "content": pa.array([c for c, *_ in pieces], pa.binary()), "windows": pa.array([w.astype("u1").tobytes() for _, w, *_ in pieces], pa.binary()),
        "docs": pa.array([d.astype("<i8").tobytes() for _, _, d, _ in pieces], pa.binary()), "keys": pa.array([k.astype("<u8").tobytes() for *_, k in pieces], pa.binary()),
    })


def _received(t: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each row, content, size, documents, keys) of the rows that a cell got."""
    windows = [np.frombuffer(x, "u1").astype("i8") for x in t.column("windows").to_pylist()]
    size = np.concatenate(windows) + SPAN - 1
    joined = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    return [len(w) for w in windows], rows_of(joined("content", "u1"), size), size, joined("docs", "<i8"), joined("keys", "<u8")


def _split(x: np.ndarray, n: list[int]) -> list[bytes]:
    return [y.tobytes() for y in np.split(x, np.cumsum(n)[:-1])]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept text][, carried columns]) for every row.

    The kept text drops bytes of characters that a cut has split. The input must give the same rows when read again, as
    tables do.
    """
    spark = df.sparkSession
    tune(spark)
    home = shared_dir(spark)
    rows = df.select(df[id_col].cast("bigint").alias("__id"), string_column(df, text_col).cast("binary").alias("__text"), *(df[c].alias(f"c_{i}") for i, c in enumerate(carry)))
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    groups = math.isqrt(max(total // SHARD_BYTES, 1))
    # set by the text: the rows between the steps are small, and adaptive execution would join the tasks that expand them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (3 * SHARD_BYTES)))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.set_column(1, "__text", t.column("__text").cast(pa.large_binary())).combine_chunks()
            shard = (part << 24) | piece
            put(f"{home}/shard-{shard}", _ipc(t))
            text, bounds, _ = _shard(t)
            start, length, key, doc = runs_of(text, bounds)
            keys, at = np.unique(key, return_inverse=True)
            low, high = np.full(len(keys), LAST), np.full(len(keys), -1)
            np.minimum.at(low, at, doc)
            np.maximum.at(high, at, doc)
            order, names, cut = _by_cell((keys % np.uint64(buckets)).astype("i8"), shard % 16777213 % buckets)
            six = keys[order].astype("<u8").view("u1").reshape(-1, 8)[:, :6]
            told = ((run_counts(text, start, length, at, len(keys)) << 1) | (low < high))[order]
            return pa.RecordBatch.from_pydict({"shard": [shard] * len(names), "bucket": names, "keys": [six[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], "told": [told[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}, schema=key_schema)

        for b in batches:
            at = 0
            while at < b.num_rows:  # cut where a shard is full
                sizes = b.column(1).slice(at)
                lengths = np.cumsum(pc.binary_length(sizes).to_numpy(zero_copy_only=False))
                n = int(np.searchsorted(lengths, SHARD_BYTES - size)) + 1
                held.append(b.slice(at, n))
                size += int(lengths[min(n, len(lengths)) - 1])
                at += n
                if size >= SHARD_BYTES:
                    yield flush()
                    held, size, piece = [], 0, piece + 1
        if any(b.num_rows for b in held):
            yield flush()
        trim()

    key_schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("told", pa.binary())])

    def shared_keys(t: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "u1").reshape(-1, 6) for x in t.column("keys").to_pylist()]
        n = [len(x) for x in lists]
        wide = np.zeros((sum(n), 8), "u1")
        wide[:, :6] = np.concatenate(lists)
        told = np.frombuffer(b"".join(t.column("told").to_pylist()), "u1")
        _, at, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(at, told & 1, len(count)) > 0)
        hot = np.bincount(at, np.exp2(told >> 1), len(count)) > HOT_RUNS
        split = lambda x: [np.packbits(y).tobytes() for y in np.split(x[at], np.cumsum(n)[:-1])]
        return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "bits": split(shared), "hot": split(hot), "wide": split(count > WIDE_SHARDS)})

    def candidate_runs(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        text, bounds, ids = _shard(_table(get(f"{home}/shard-{shard}")))
        start, length, key, doc = runs_of(text, bounds)
        keys, at = np.unique(key, return_inverse=True)
        order, names, cut = _by_cell((keys % np.uint64(buckets)).astype("i8"), shard % 16777213 % buckets)
        shared, hot, wide = (np.zeros(len(keys), bool) for _ in range(3))
        for b, *bits in zip(*(t.column(c).to_pylist() for c in ("bucket", "bits", "hot", "wide")), strict=True):
            k = int(np.searchsorted(names, b))
            for x, y in zip((shared, hot, wide), bits, strict=True):
                x[order[cut[k] : cut[k + 1]]] = np.unpackbits(np.frombuffer(y, "u1"), count=int(cut[k + 1] - cut[k]))
        take = shared[at]
        start, length, key, doc, single, spread = start[take], length[take], key[take], doc[take], hot[at][take], wide[at][take]
        start, windows, which = cut_runs(start, length, np.where(single, 1, RUN))
        key, doc, single, spread = key[which], doc[which], single[which], spread[which]
        size = windows + SPAN - 1
        content = gathered(text, start, size)
        key = np.where(single, content_keys(content), key)
        first, same = collapse(content, size)
        low = np.full(len(first), LAST)
        np.minimum.at(low, same, ids[doc])
        put(f"{home}/runs-{shard}", _ipc(pa.table({"start": start, "windows": windows.astype("u1"), "doc": doc, "same": same, "low": low[same]})))
        group = (shard >> 24) * 7919 + (shard & 0xFFFFFF)
        # equal windows have equal keys, single ones by their bytes too, so what is equal goes one way in all shards
        cell = (key[first] % np.uint64(buckets)).astype("i8") + np.where(spread[first], (1 + group % groups) * buckets, 0)
        order, names, cut = _by_cell(cell, shard % 16777213 % buckets)
        put(f"{home}/order-{shard}", _ipc(pa.table({"order": order})))
        first, low = first[order], low[order]
        parts = [(first[a:b], low[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        inside = np.arange(content.shape[1])
        return _runs_table(shard, names, [(content[f][inside < size[f][:, None]].tobytes(), windows[f], x, key[f]) for f, x in parts])

    def verdicts(t: pa.Table) -> pa.Table:
        n, content, size, docs, keys = _received(t)
        bits = smaller_elsewhere(content, size, docs, keys) if len(size) else np.zeros(0, "<u4")
        return pa.table({"shard": t.column("shard"), "cell": t.column("cell"), "bits": pa.array(_split(bits, n), pa.binary())})

    def first_meeting(t: pa.Table) -> pa.Table:
        """The verdicts of a bucket; or, in a group of shards, their equal runs as one, sent on under the cell's own name."""
        cell = t.column("cell")[0].as_py()
        if cell < buckets:
            out = verdicts(t)
            for c in ("content", "windows", "docs", "keys"):
                out = out.append_column(c, pa.nulls(len(out), pa.binary()))
            return out
        n, content, size, docs, keys = _received(t)
        first, same = collapse(content, size)
        low = np.full(len(first), LAST)
        np.minimum.at(low, same, docs)
        put(f"{home}/group-{cell}", _ipc(pa.table({"same": same, "above": docs > low[same], "shard": np.repeat(t.column("shard").to_numpy(), n)})))
        inside = np.arange(content.shape[1]) < size[first][:, None]
        return _runs_table(cell, np.array([cell % buckets]), [(content[first][inside].tobytes(), size[first] - SPAN + 1, low, keys[first])])

    def handed_back(t: pa.Table) -> pa.Table:
        """A group's verdicts to its shards: a document above the group's smallest has all windows of the run elsewhere."""
        cell = t.column("shard")[0].as_py()
        own = _table(get(f"{home}/group-{cell}"))
        same, above, shard = (own.column(c).to_numpy(zero_copy_only=False) for c in ("same", "above", "shard"))
        bits = np.where(above, np.uint32(0xFFFFFFFF), np.frombuffer(t.column("bits")[0].as_py(), "<u4")[same]).astype("<u4")
        begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, "i8")
        return pa.table({"shard": pa.array(shard[begin], pa.int64()), "cell": pa.array([cell] * len(begin), pa.int64()), "bits": pa.array(_split(bits, np.diff(np.append(begin, len(shard))).tolist()) if len(begin) else [], pa.binary())})

    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string())] if with_text else [])

    def cut(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        table = _table(get(f"{home}/shard-{shard}"))
        text, bounds, ids = _shard(table)
        runs = _table(get(f"{home}/runs-{shard}"))
        order = _table(get(f"{home}/order-{shard}")).column("order").to_numpy()
        answer = sorted(zip(t.column("cell").to_pylist(), t.column("bits").to_pylist(), strict=True))
        bits = np.zeros(len(order), "u4")
        bits[order] = np.frombuffer(b"".join(x for _, x in answer), "<u4")
        start, windows, doc, same, low = (runs.column(c).to_numpy() for c in ("start", "windows", "doc", "same", "low"))
        mask = np.where(ids[doc] > low, np.uint32(0xFFFFFFFF), bits[same]) if len(same) else np.zeros(0, "u4")
        edge = np.zeros(len(text) + SPAN + 1, "i4")
        for k in range(RUN):
            at = start[(windows > k) & ((mask >> np.uint32(k)) & np.uint32(1)).astype(bool)] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + SPAN, -1)
        gone = np.cumsum(edge[: len(text)]) > 0
        out: dict[str, list] = {f: [] for f, _ in fields}
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            g = gone[a:b]
            kept = text[a:b][~g].tobytes() if g.any() else text[a:b].tobytes()
            out["n_bytes"].append(int(b - a))
            out["n_removed"].append(int(g.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(np.concatenate([[0], g.view("i1")])) == 1)))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept.decode("utf-8", "ignore"))
        out["id"] = table.column("__id").to_pylist()
        made = pa.table({f: pa.array(out[f], kind) for f, kind in fields})
        for i in range(len(carry)):
            made = made.append_column(f"c_{i}", table.column(f"c_{i}"))
        return made

    def trimmed(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            release()
            out = fn(t)
            trim()
            return out

        return run

    def meet(df: DataFrame, by: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """fn over the groups of by; the numbers are dealt out in turn, so that no task gets many of them by chance."""
        dealt = df.withColumn("slot", F.pmod(F.col(by), F.lit(tasks)).cast("int")).repartitionById(tasks, "slot")
        return dealt.groupBy("slot", by).applyInArrow(lambda t: trimmed(fn)(t.drop_columns(["slot"])), schema)

    verdict = "shard bigint, cell bigint, bits binary"
    runs = f"{verdict}, content binary, windows binary, docs binary, keys binary"
    told = rows.mapInArrow(shards, "shard bigint, bucket bigint, keys binary, told binary")
    told = meet(told, "bucket", shared_keys, "shard bigint, bucket bigint, bits binary, hot binary, wide binary")
    told = told.repartition(tasks, "shard").groupBy("shard").applyInArrow(trimmed(candidate_runs), runs)
    met = staged(meet(told, "cell", first_meeting, runs))
    again = meet(met.where("content IS NOT NULL"), "cell", verdicts, verdict)
    told = met.where("content IS NULL").select("shard", "cell", "bits").unionAll(meet(again, "shard", handed_back, verdict))
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_text else "") + "".join(f", c_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return told.repartition(tasks, "shard").groupBy("shard").applyInArrow(trimmed(cut), schema)
