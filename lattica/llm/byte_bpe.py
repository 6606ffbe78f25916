"""Byte-level BPE by ranks, as a monoid tree reduction.

A text is halved until the pieces are short; pieces are encoded and joined up the tree. A join keeps what provably cannot
change and encodes anew only a window around the seam, which grows until its outside stands:

* between pattern matches: a match is final if the pattern has seen all it looks at, one character beyond it or the third
  of its start (a property of the pattern dealt; one that looks further needs another bound in _join_texts); scanning on from a final match gives the same matches from the first one that ends where a match of the
  right half ends;
* between tokens of one long match: a sequence of tokens is the encoding of its bytes if and only if every two neighbours
  are the encoding of their own bytes, so a window is wide enough once the pairs at both of its edges are. That holds if every
  token is the encoding of its own bytes, which is checked for all; for other ranks a long match is merged as one, by a heap.

Decoding concatenates the tokens' bytes up the same kind of tree.

Null and empty texts have no tokens; a very long one goes through the tree like any other; rows repeat as they come; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, map_arrow, string_column

#: Characters of a leaf of the text's tree; bytes of a leaf of a long match's tree.
LEAF_CHARS, LEAF_BYTES = 4096, 48
#: Bytes from which merging takes its next pair from a heap rather than by looking at all.
HEAP_BYTES = 256
CACHE = 300_000


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # the theorem on neighbours needs each token to encode to itself
        self.closed = all(self._merge(k) == [v] for k, v in ranks.items())

    def _merge(self, raw: bytes) -> list[int]:
        """The definition: merge the leftmost pair of lowest rank until none is left."""
        rank = self.ranks
        if len(raw) == 1:
            return [rank[raw]]
        if len(raw) > HEAP_BYTES:
            return self._merge_by_heap(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get = rank.get
        pairs = [get(raw[i : i + 2], 1 << 60) for i in range(len(raw) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return [rank[p] for p in parts]

    def _merge_by_heap(self, raw: bytes) -> list[int]:
        """The same: a part is known by where it begins, a pair by its rank, its begin and its end."""
        get, n = self.ranks.get, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            middle = end[i]
            if not i < middle < n or end[middle] != e:  # one of the two has been merged since
                continue
            end[i], end[middle], before[e] = e, 0, i
            for a, z in ((before[i], e), (i, end[e] if e < n else 0)):
                if a >= 0 and z and (r := get(raw[a:z])) is not None:
                    heapq.heappush(heap, (r, a, z))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _pair(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            found = self.fits[key] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._pair(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            middle = self._merge(window) if len(window) <= 4 * LEAF_BYTES else self._tree(window)
            if (i == 0 or self._pair(left[i - 1], middle[0])) and (j == len(right) or self._pair(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            if i == 0 and j == len(right):
                return middle
            size *= 2

    def _tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES or not self.closed:
            return self._merge(raw)
        level = [self._merge(raw[i : i + LEAF_BYTES]) for i in range(0, len(raw), LEAF_BYTES)]
        while len(level) > 1:
            level = [self._join_tokens(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def word(self, w: str) -> tuple[int, ...]:
        raw = w.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        return (rank,) if rank is not None else tuple(self._tree(raw))

    def _leaf(self, text: str) -> tuple[list[int], list[str]]:
        """(ends of matches, matches)."""
        words = self.split.findall(text)
        at, ends = 0, []
        for w in words:
            at += len(w)
            ends.append(at)
        return ends, words

    def _join_texts(self, left: tuple, right: tuple) -> tuple:
        (le, lw), (re_, rw) = left, right
        if not le or not re_:
            return (le + re_, lw + rw)
        size, seam = le[-1], le[-1]
        keep = len(le)
        while keep and le[keep - 1] + 2 > size:
            keep -= 1
        # a match whose third character is unseen may still become one of the short endings
        while keep and (le[keep - 2] if keep > 1 else 0) + 3 > size:
            keep -= 1
        base = le[keep - 1] if keep else 0
        right_ends, grow = set(re_), 2
        tail = "".join(lw[keep:])
        while True:
            j = min(len(rw), grow)
            text = tail + "".join(rw[:j])
            whole, end, words, ends = j == len(rw), base + len(text), [], []
            for m in self.split.finditer(text):
                e = base + m.end()
                if not whole and (e + 2 > end or base + m.start() + 3 > end):
                    break
                words.append(m[0])
                ends.append(e)
                if e > seam and e - seam in right_ends:
                    k = re_.index(e - seam) + 1
                    return le[:keep] + ends + [x + seam for x in re_[k:]], lw[:keep] + words + rw[k:]
            if whole:
                return le[:keep] + ends, lw[:keep] + words
            grow *= 2

    def words(self, text: str) -> list[str]:
        level = [self._leaf(text[i : i + LEAF_CHARS]) for i in range(0, len(text), LEAF_CHARS)]
        while len(level) > 1:
            level = [self._join_texts(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][1] if level else []

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    known[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 1024])) for i in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


held(codec.cache_clear)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): one pass, no shuffle. path is a vocabulary on every machine."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
        columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids])]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names + (["ids"] if with_ids else []))

    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_arrow(df.select(df[id_col].alias("id"), string_column(df, text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)
