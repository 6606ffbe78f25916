"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and towards its own diagonal; the score is the
logistic of the difference of Mahalanobis log densities, from cached Cholesky factors. Class sums are added up per task
over all labelled rows, so the driver only sees (1 + d + d*d) numbers a task and class.

A null or empty text has the statistics of the empty text and a score like any other; very long texts are taken whole; rows without
a label only get a score; a class without rows takes the pooled figures (no labelled rows at all: every score is the prior 0.5);
repeated rows repeat; a score equal to the cut is predicted 1; an empty table gives an empty result. Extra columns are ignored under any
name. Label, language, source and id are no input of a score.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged, string_column
from .rules import measure

#: Transformed statistics: log size, and log odds of shares, each with 20 cases added of which one counts, so that short texts are near the middle.
FEATURES = ("log_words", "word_length", "symbols", "punctuation", "dup_lines", "repeat_words", "upper", "said_before", "top_word", "digits", "pipes", "shouts", "stops", "adjacent", "line_words", "log_bytes_a_char")


def statistics(raws: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text in UTF-8."""
    m = measure(raws)
    words = m["n_words"].astype(float)
    chars = m["word_chars"].astype(float)
    odds = lambda a, n: np.log((a + 1) / (np.maximum(n - a, 0) + 19))
    count = lambda chosen: np.array([len(r) - len(r.translate(None, chosen)) for r in raws], float)
    distinct, adjacent = np.zeros(len(raws)), np.zeros(len(raws))
    for i, r in enumerate(raws):
        ws = r.split()
        distinct[i] = len(set(ws))
        adjacent[i] = sum(map(bytes.__eq__, ws, ws[1:]))
    size = np.array([len(r) for r in raws], float)
    return np.column_stack([
        np.log1p(words), np.log((chars + 1) / (words + 1)), odds(m["n_symbols"], chars + m["n_symbols"]), odds(count(b".,;:!?"), chars + 1),
        odds(m["n_dup_lines"], m["n_lines"]), odds(m["n_repeat_words"], words), odds(m["n_upper"], m["n_letters"]), odds(words - distinct, words),
        odds(m["n_top_word"], words), odds(count(b"0123456789"), chars), odds(count(b"|"), words + count(b"|")), odds(count(b"!"), words + count(b"!")),
        odds(m["n_stops"], words + m["n_stops"]), odds(adjacent, words), np.log((words + 1) / (m["n_lines"] + 1)), np.log((size + 1) / (chars + 1)),
    ])


@dataclasses.dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray  # the inverse of the lower Cholesky factor of each class's covariance, itself lower triangular
    log_dets: np.ndarray
    log_priors: np.ndarray
    degrees: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        out = []
        for k in (0, 1):
            z = self.factors[k] @ (x - self.means[k]).T
            out.append(self.log_priors[k] - self.log_dets[k] - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(out[0] - out[1], -500, 500)))


def inverse(low: np.ndarray) -> np.ndarray:
    """Of a lower triangular matrix, by forward substitution; done once, so that scoring is one product a class."""
    out = np.zeros_like(low)
    for i in range(len(low)):
        out[i] = ((np.arange(len(low)) == i) - low[i, :i] @ out[:i]) / low[i, i]
    return out


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink_pooled: float = 0.5, shrink_diagonal: float = 0.1, floor: float = 0.01) -> Discriminant:
    """sums: per class the number of rows, the sum of x, the sum of x x'."""
    d = len(FEATURES)
    zero = (0.0, np.zeros(d), np.zeros((d, d)))
    n, s, ss = zip(*(sums.get(k, zero) for k in (0, 1)), strict=True)
    total = max(sum(n), 1.0)
    within = [ss[k] - np.outer(s[k], s[k]) / max(n[k], 1.0) for k in (0, 1)]
    pooled = (within[0] + within[1]) / max(total - 2, 1.0)
    means, factors, dets = [], [], []
    for k in (0, 1):
        own = within[k] / max(n[k] - 1, 1.0) if n[k] > 1 else pooled
        weight = shrink_pooled if n[k] > 1 else 1.0
        c = (1 - weight) * own + weight * pooled
        c = (1 - shrink_diagonal) * c + shrink_diagonal * np.diag(np.diag(c)) + floor * np.eye(d)
        low = np.linalg.cholesky(c)
        means.append(s[k] / n[k] if n[k] else (s[0] + s[1]) / total)
        factors.append(inverse(low))
        dets.append(np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(dets), np.log((np.array(n) + 1) / (total + 2)), total)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, x array<double>[, carried columns]); one pass, no shuffle."""
    schema = ", ".join(f"`{n}` {t}" for n, t in [("id", df.schema[id_col].dataType.simpleString()), ("x", "array<double>"), *((c, df.schema[c].dataType.simpleString()) for c in carry)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics([(t or "").encode() for t in b.column(1).to_pylist()])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), flat, *b.columns[2:]], ["id", "x", *carry])

    return map_arrow(df.select(df[id_col].alias("id"), string_column(df, text_col).alias("text"), *carry), run, schema).withColumnRenamed("id", id_col)


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """rows(y, x): the sums that fit() needs, added up per task; what reaches the driver is one short row a task and class."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for b in batches:
            if b.num_rows:
                y, x = np.array(b.column(0).to_pylist()), np.asarray(b.column(1).flatten()).reshape(-1, d)
                for k in (0, 1):
                    z = x[y == k]
                    acc[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"y": [0, 1], "v": [acc[0].tolist(), acc[1].tolist()]}, schema=pa.schema([("y", pa.int64()), ("v", pa.list_(pa.float64()))]))

    parts = rows.select(F.col("y").cast("bigint").alias("y"), "x").mapInArrow(run, "y bigint, v array<double>")
    summed = parts.select("y", F.posexplode("v").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in summed:
        out[r.y][r.k] = r.v
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Discriminant:
    """Learns from the rows of labels(id, quality) that are not held out; an id with several labels counts each once."""
    y = labels.where(F.col("quality").isin(0, 1) & ~held_out(id_col)).select(id_col, F.col("quality").alias("y")).distinct()
    return fit(class_sums(stats.join(y, id_col)))


def score(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score[, carried columns])."""
    d = len(FEATURES)
    schema = ", ".join(f"`{n}` {t}" for n, t in [("id", stats.schema[id_col].dataType.simpleString()), ("score", "double"), *((c, stats.schema[c].dataType.simpleString()) for c in carry)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(np.asarray(b.column(1).flatten()).reshape(-1, d))), *b.columns[2:]], ["id", "score", *carry])

    return map_arrow(stats.select(F.col(id_col).alias("id"), "x", *carry), run, schema).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted). The statistics, 16 numbers a text, are written once for learning and scoring."""
    stats = staged(document_statistics(docs, id_col, text_col))
    scored = score(stats, learn(stats, labels, id_col), id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
