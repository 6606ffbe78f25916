"""Rule bitmask ledger: every quality rule is evaluated once per text, failures go into a bitmask beside the measurements,
and versioned policies are masks over that ledger. Ablations are bitwise aggregates over the ledger, never a new scan.

A null text is the empty text: all measurements 0. Very long texts are measured whole, one at a time. A measure that is just at a rule's bound
passes. Rows repeat as they come; an empty table gives an empty ledger; extra columns are ignored under any name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, string_column

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Bits of the ledger; their order is part of its format.
RULES = ("few_words", "repeat_words", "symbols", "dup_lines", "word_length", "shouting", "top_word", "no_sentences", "stutter")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_top_word", "n_stops", "n_stutter")
#: A policy is the set of rules whose failure drops a text.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeat_words"),
    "v2": ("few_words", "repeat_words", "symbols", "word_length", "shouting", "top_word", "stutter"),
}
BASE, CURRENT = "v1", "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it; exact: ranks of pairs, then of pairs of pairs."""
    if len(ids) < window:
        return np.zeros(n_docs, "i8")
    rank, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pair = (rank[:-step].astype("u8") << np.uint64(32)) | rank[step:].astype("u8")
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    starts = np.flatnonzero(doc[: len(rank)] == doc[window - 1 :][: len(rank)])
    key = (doc[starts].astype("u8") << np.uint64(32)) | rank[starts].astype("u8")
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[count[inverse] > 1]
    edge = np.zeros(len(ids) + 1, "i8")
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_SENTENCE = re.compile(rb"[.!?](?=[\s\"')]|$)")


def measure(raws: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of some texts in UTF-8. bytes.split() parts exactly at space and at 0x09 to 0x0D."""
    n, words = len(raws), [r.split() for r in raws]
    out = {m: np.zeros(n, "i8") for m in MEASURES}
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), "u4")
    out["n_words"][:] = [len(ws) for ws in words]
    doc = np.repeat(np.arange(n, dtype="u4"), out["n_words"])
    again = doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])]
    out["n_stutter"] = np.bincount(again, minlength=n)
    out["n_repeat_words"] = repeats(ids, doc, n)
    drop = bytes(b for b in range(256) if b not in SYMBOLS)
    for i, r in enumerate(raws):
        body = np.frombuffer(r, "u1")
        out["word_chars"][i] = int(np.count_nonzero((body & 0xC0) != 0x80)) - (len(r) - len(r.translate(None, b" \t\n\v\f\r")))
        out["n_symbols"][i] = len(r.translate(None, drop))
        lines = [x for x in r.split(b"\n") if x.strip()]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        upper, letters = len(r) - len(r.translate(None, UPPER)), len(r) - len(r.translate(None, LETTERS))
        if not r.isascii():
            other = "".join(_FOREIGN.findall(r.decode("utf-8", "replace")))
            upper, letters = upper + sum(map(str.isupper, other)), letters + sum(map(str.isalpha, other))
        out["n_upper"][i], out["n_letters"][i] = upper, letters
        out["n_stops"][i] = len(_SENTENCE.findall(r))
    if len(ids):
        pair, count = np.unique((doc.astype("u8") << np.uint64(32)) | ids, return_counts=True)
        np.maximum.at(out["n_top_word"], (pair >> np.uint64(32)).astype("i8"), count)
    return out


def failures(m: Mapping[str, np.ndarray]) -> np.ndarray:
    """The ledger's bits; thresholds are whole numbers or ratios compared by cross products."""
    w = m["n_words"]
    checks = {
        "few_words": w < 20,
        "repeat_words": 100 * m["n_repeat_words"] > 30 * w,
        "symbols": 100 * m["n_symbols"] > 30 * w,
        "dup_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "word_length": (m["word_chars"] < 2 * w) | (m["word_chars"] > 15 * w),
        "shouting": (2 * m["n_upper"] > m["n_letters"]) & (m["n_letters"] > 0),
        "top_word": 100 * m["n_top_word"] > 30 * w,
        "no_sentences": m["n_stops"] == 0,
        "stutter": 100 * m["n_stutter"] > 20 * w,
    }
    bits = np.zeros(len(w), "i8")
    for i, r in enumerate(RULES):
        bits |= checks[r].astype("i8") << i
    return bits


def rule_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measurements, failed bits): one pass, no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = measure([(x or "").encode() for x in b.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(failures(m), pa.int64())], ["id", *MEASURES, "failed"])

    schema = f"id {id_type}, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", failed bigint"
    return map_arrow(df.select(df[id_col].alias("id"), string_column(df, text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def apply_policy(ledger: DataFrame, policy: str, into: str = "kept") -> DataFrame:
    return ledger.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only): texts that fail the rule, and texts that this rule alone would drop under the policy."""
    m = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(m))
    named = [r for r in RULES if m >> RULES.index(r) & 1]
    sums = [x for r in named for x in (F.sum((hit.bitwiseAND(F.lit(1 << RULES.index(r))) != 0).cast("bigint")).alias(f"{r}_f"), F.sum((hit == F.lit(1 << RULES.index(r))).cast("bigint")).alias(f"{r}_o"))]
    row = ledger.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(f"{r}_f", F.lit(0)).alias("n_failed"), F.coalesce(f"{r}_o", F.lit(0)).alias("n_only")) for r in named))).alias("x")).select("x.*")
