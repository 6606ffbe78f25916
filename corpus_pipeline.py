"""A corpus pipeline: quality, near copies, repeated passages, secrets, packing; each stage written and read again.

Every stage works on all that the one before kept, and all but the last return the columns of documents, whatever extra ones there
are. A null text counts as empty, and texts of any length are taken whole. Rows without an id are documents like others, and come
after all others in the near-copy stage; rows of one id and different texts are different documents there, and of equal rows it
leaves one. An empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import kept_rows, map_arrow, shared_dir, staged, string_column, table, texts, tune
from lattica.llm.near_copies import first_of_copies
from lattica.llm.packing import pack_documents
from lattica.llm.quality import document_statistics, learn, score
from lattica.llm.secret_scan import redact
from lattica.llm.suffix_dedup import suffix_dedup

CUT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier scores below CUT. Statistics are taken once, and the texts are not shuffled."""
    text = string_column(docs)
    keys = {"__text": F.xxhash64(text), "__size": F.octet_length(text)}  # the score is the text's alone
    stats = staged(document_statistics(docs.select("doc_id", "text", *(c.alias(k) for k, c in keys.items())), carry=tuple(keys)))
    scored = score(stats, learn(stats, table(spark, sf_dir, "labels")), carry=tuple(keys))
    decided = staged(scored.select(*keys, (F.col("score") < CUT).alias("gone"), F.lit(False).alias("repeated")).distinct())
    return kept_rows(docs.select("*", *(c.alias(k) for k, c in keys.items())), decided, list(keys)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each component of texts whose sets of five-word shingles are 0.8 alike."""
    return first_of_copies(docs)


def _with_text(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    own = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return df.select(*(own.get(c, F.col(c)).alias(c) for c in columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what an earlier document has; documents stay, if need be with an empty text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup(docs, carry=rest, with_text=True).select(F.col("id").alias("doc_id"), F.col("kept").alias("new_text"), *(F.col(f"c_{i}").alias(c) for i, c in enumerate(rest)))
    return _with_text(cut, "new_text", docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets."""
    at = docs.columns.index("text")

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.set_column(at, "text", pa.array([redact(t) for t in texts(b.column(at))], pa.string()))

    cleaned = map_arrow(docs.withColumn("text", string_column(docs)), clean, docs.schema)
    return _with_text(cleaned, "text", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]
#: SQL can express none of the stages but their order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, home = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
