"""Packs documents into sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups.

A document is cut into full sequences and one remainder. Pieces go to random groups of 4096 on average at most, packed independently.
Groups are of pieces, not of whole documents: a full piece fills its sequence wherever it is, so only remainders are packed at all, one a
document, and a huge document makes no group large. Sequences are padded to the full length, except those that end at a power of two.

A null text is the empty text; it is one piece with the end id alone. Ids are cast to bigint, and one that is no number raises. Ties of length keep the order (length, doc_id, start).
Repeated rows are packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_column, trim, tune
from .tokenize import encoder

#: Pieces in a random group, on average, at most.
GROUP_PIECES = 4096


class Tournament:
    """A winner tree over bins: each inner node holds the largest room below it; first-fit descends to the leftmost bin."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.room = [capacity, capacity]

    def _grow(self) -> None:
        old, n = self.room, self.leaves
        self.leaves = 2 * n
        self.room = [self.capacity] * (4 * n)
        self.room[2 * n : 3 * n] = old[n:]
        for i in range(2 * n - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of the first bin with room."""
        while self.room[1] < size:
            self._grow()
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            i += room[i] < size
        offset, room[i] = self.capacity - room[i], room[i] - size
        found = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.used = max(self.used, found + 1)
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, for sizes in any order; the largest are placed first, ties as they come."""
    bins, offsets, tree = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8"), Tournament(capacity)
    order = np.argsort(-sizes, kind="stable")
    full = int(np.searchsorted(-sizes[order], -capacity, "right"))
    bins[order[:full]] = np.arange(full)  # full pieces fill the first bins, one each
    for k in order[full:]:
        b, offsets[k] = tree.place(int(sizes[k]))
        bins[k] = full + b
    return bins, offsets


def document_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): no shuffle; ids are kept only if asked for."""
    tune(df.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            rows: list[tuple] = []
            for i, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                x = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for a in range(0, len(x), capacity):
                    y = x[a : a + capacity]
                    rows.append((i, a, len(y), zlib.crc32(y.tobytes()), len(x), *([y.tolist()] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
        trim()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), string_column(df, text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset, and seq_tokens and padded, the sequence's lengths before and after padding.

    Groups are dealt by a hash of the whole piece's document and position, so neither a source nor a repeated id is hot.
    """
    # a token is a byte at least, so there are no more pieces than this
    most = df.agg(F.sum(F.floor(F.octet_length(string_column(df, text_col)) / F.lit(capacity)) + 1)).first()[0] or 0
    groups = max(1, -(-most // group_pieces))
    pieces = document_pieces(df, tokenizer, end_id, capacity, with_ids, id_col, text_col)
    names = pieces.columns
    # a repeated id or text must not make a hot group: the row's place in its partition salts the hash
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy("i8"), capacity)
        total = np.bincount(bins, weights=pdf["length"], minlength=1).astype("i8")[bins]
        return pdf[names].assign(sequence_id=(int(pdf["grp"].iloc[0]) << 32) + bins, offset=offsets, seq_tokens=total, padded=np.where((total & (total - 1)) == 0, total, capacity))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint, seq_tokens bigint, padded bigint"
    return dealt.groupBy("grp").applyInPandas(run, schema)
