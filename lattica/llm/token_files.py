"""Token ids in fixed-width bit-packed shard files, with block offsets for vectorised unpacking and random access.

File: header (magic, width, block size, numbers of ids and documents), the document directory (id, validity, first id), the
block offsets, then the blocks. A block holds block_size ids of `width` bits, least significant bit first, padded to whole
bytes; the last may be shorter. Shards cover ascending ranges of doc_id; the manifest names each shard's first id.

A null text is the empty text (its end id alone); a very long one is a shard of its own; null ids come first; ids are cast to bigint, and
one that is no number raises; rows of one id keep together, ordered by a hash of the text; an empty table gives no shards; extra
columns are ignored. An id that the width can't hold raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, partitions_for, put, shared_dir, staged, string_column, trim, tune
from .tokenize import encoder, vocabulary_size

MAGIC, HEAD, BLOCK = b"LTKF", struct.Struct("<4sIIIQQ"), 4096


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit into {width} bits")
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype("u4")[:, None] >> np.arange(width, dtype="u4")) & 1
    return np.packbits(bits.astype("u1").ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(raw, "<u2", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, "u1"), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("u4") << np.arange(width, dtype="u4")).sum(1, dtype="u4").astype("<u4")


def pack_file(doc_ids: np.ndarray, valid: np.ndarray, starts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([HEAD.pack(MAGIC, width, BLOCK, 0, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), starts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Opens a shard by its directory; ids(a, b) reads only the blocks that hold them."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        magic, self.width, self.block, _, self.n_ids, self.n_docs = HEAD.unpack(self.f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.doc_ids = np.frombuffer(self.f.read(8 * self.n_docs), "<i8")
        self.valid = np.frombuffer(self.f.read(self.n_docs), "u1").astype(bool)
        self.starts = np.append(np.frombuffer(self.f.read(8 * self.n_docs), "<u8").astype("i8"), self.n_ids)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.f.read(8 * (n_blocks + 1)), "<u8").astype("i8")
        self.base = self.f.tell()

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, "<u4")
        i, j = a // self.block, -(-b // self.block)
        raw = self.f.read_at(int(self.offsets[j] - self.offsets[i]), self.base + int(self.offsets[i]))
        parts, at = [], 0
        for k in range(i, j):
            size = int(self.offsets[k + 1] - self.offsets[k])
            parts.append(unpack(raw[at : at + size], min(self.block, self.n_ids - k * self.block), self.width))
            at += size
        return np.concatenate(parts)[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Ids in a shard file at most, but for a longer document: bounds a task's memory.
SHARD_IDS = 4 << 20
#: Bytes of text in a range partition, about.
PART_BYTES = 64 << 20


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, out: str, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest (part, piece, path, n_docs, n_ids, start), one row a shard.

    Texts are range-partitioned by id and sorted, then encoded and written where they lie; partitions number as the bytes of
    text. The manifest is a table; the driver sees one number a partition. The width is that of the tokenizer's vocabulary, or of a
    larger one given.
    """
    spark = df.sparkSession
    tune(spark)
    width = width_for(max(vocabulary_size(tokenizer), end_id + 1, vocabulary or 0))
    told = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        names: list[int] = []
        valid: list[bool] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], "i8")
            path = f"{out}/part-{part:06d}-{piece:04d}.ltk"
            put(path, pack_file(np.array(names, "i8"), np.array(valid), np.cumsum(lengths) - lengths, np.concatenate(held), width))
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "path": [path], "n_docs": [len(held)], "n_ids": [int(lengths.sum())]}, schema=told)

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                names.append(name or 0)
                valid.append(name is not None)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= SHARD_IDS:
                    yield flush()
                    names, valid, held, size, piece = [], [], [], 0, piece + 1
        if held:
            yield flush()
        trim()

    rows = df.select(df[id_col].cast("bigint").alias("id"), string_column(df, text_col).alias("text"))
    n = partitions_for(rows, "text", PART_BYTES)
    by = [F.col("id").asc_nulls_first(), F.col("h"), F.col("m")]
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id())  # so that a repeated id can be split
    shards = placed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, "part int, piece int, path string, n_docs bigint, n_ids bigint")
    written = staged(shards)
    sums = written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a partition
    before, at = [], 0
    for part, ids in sorted(sums):
        before.append((part, at))
        at += ids
    offsets = spark.createDataFrame(before, "part int, base bigint")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("part", "piece", "path", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("start"))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the shards."""
    spark: SparkSession = manifest.sparkSession
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                for lo in range(0, f.n_docs, 512):
                    hi = min(f.n_docs, lo + 512)
                    ids, at = f.ids(int(f.starts[lo]), int(f.starts[hi])), int(f.starts[lo])
                    docs = [ids[int(f.starts[k]) - at : int(f.starts[k + 1]) - at] for k in range(lo, hi)]
                    columns = [pa.array(f.doc_ids[lo:hi], pa.int64(), mask=~f.valid[lo:hi]), pa.array(f.starts[lo:hi] + base), pa.array([len(x) for x in docs], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in docs], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(docs, pa.list_(pa.int32()))] if with_ids else []), schema=pa.schema(fields))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return manifest.select("path", "start").repartition(n).mapInArrow(run, schema)


def token_files(df: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int | None = None) -> DataFrame:
    out = shared_dir(df.sparkSession)
    return read_token_files(write_token_files(df, tokenizer, end_id, out, vocabulary))
