"""The driver's queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_round_trip
from .common import table
from .embedding_dedup import embedding_components
from .packing import pack_documents
from .quality import classify
from .rules import BASE, CURRENT, POLICIES, RULES, ablations, apply_policy, rule_ledger
from .secret_scan import KINDS, secret_scan
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .token_files import token_files
from .warc import warc_round_trip


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(apply_policy(rule_ledger(table(spark, sf_dir, "documents")), CURRENT), BASE, "base_kept")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy drops, and what it alone does, from the ledger of op8."""
    return ablations(rule_ledger(table(spark, sf_dir, "documents")), CURRENT)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scans, op2_packing, op3_token_files, op4_warc, op5_quality_classifier, op6_byte_bpe, op7_suffix_dedup, op8_quality_rules, rule_ablations, op9_embedding_dedup, op10_simhash_dedup)}

_LEDGER = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
        w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM s)),
        g AS (SELECT doc_id, i, word = lag(word) OVER o AS again, string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram, lead(word, 7) OVER o AS last
              FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        twice AS (SELECT doc_id, unnest(list(i)) AS i FROM g WHERE last IS NOT NULL GROUP BY doc_id, gram HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY doc_id),
        stutter AS (SELECT doc_id, count(*) FILTER (again) AS n_stutter FROM g GROUP BY doc_id),
        top AS (SELECT doc_id, max(n) AS n_top_word FROM (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word) GROUP BY doc_id),
        m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters,
                     coalesce(n_top_word, 0) AS n_top_word, coalesce(n_stutter, 0) AS n_stutter, regexp_matches(t, '[.!?]([\x20\x09-\x0D"'')]|$)') AS ends
              FROM s LEFT JOIN covered USING (doc_id) LEFT JOIN stutter USING (doc_id) LEFT JOIN top USING (doc_id)),
        f AS (SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS rep, 100 * n_symbols > 30 * n_words AS sym, 100 * n_dup_lines > 30 * n_lines AS dup,
                     word_chars < 2 * n_words OR word_chars > 15 * n_words AS long, 2 * n_upper > n_letters AND n_letters > 0 AS loud, 100 * n_top_word > 30 * n_words AS top,
                     NOT ends AS endless, 100 * n_stutter > 20 * n_words AS stut FROM m)"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT payload_digest AS g, max(page_id) AS lead FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> lead THEN lead END AS refers_to
        FROM d LEFT JOIN m ON payload_digest = g""",
    # needs some 50 bytes for each byte of the tables; the driver compares at sf0.01
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS i FROM d)),
        low AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT DISTINCT doc_id, i FROM w JOIN low USING (s) WHERE m < doc_id),
        marked AS (SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS INT) AS new FROM hit),
        numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
        spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, k),
        per AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS n, list(struct_pack(a := a, z := z) ORDER BY a) AS l FROM spans GROUP BY doc_id),
        pieces AS (SELECT doc_id, b, unnest(range(n + 1)) AS j, n, l FROM d JOIN per USING (doc_id)),
        kept AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, CASE WHEN j = 0 THEN 1 ELSE l[j].z + 1 END, CASE WHEN j = n THEN octet_length(b) ELSE l[j + 1].a END)), '' ORDER BY j)) AS rest FROM pieces GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(coalesce(rest, b)) AS kept_sha256
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_quality_rules": _LEDGER
    + """
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, few OR rep AS base_failed,
               NOT (few OR rep OR sym OR long OR loud OR top OR stut) AS kept,
               CAST(few AS BIGINT) + 2 * CAST(rep AS BIGINT) + 4 * CAST(sym AS BIGINT) + 8 * CAST(dup AS BIGINT) + 16 * CAST(long AS BIGINT) + 32 * CAST(loud AS BIGINT)
               + 64 * CAST(top AS BIGINT) + 128 * CAST(endless AS BIGINT) + 256 * CAST(stut AS BIGINT) AS failed
        FROM f""",
    "rule_ablations": _LEDGER
    + f"""
        , b AS (SELECT few::INT + 2 * rep::INT + 4 * sym::INT + 16 * long::INT + 32 * loud::INT + 64 * top::INT + 256 * stut::INT AS hit FROM f),
        r(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << RULES.index(r)})" for r in POLICIES[CURRENT])})
        SELECT rule, count(*) FILTER (hit & bit <> 0) AS n_failed, count(*) FILTER (hit = bit) AS n_only FROM r LEFT JOIN b ON true GROUP BY rule""",
    # all pairs, and every label that passes a vector: for small tables
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
        pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a),
        reach AS (SELECT vec_id AS node, vec_id AS label FROM good UNION SELECT b, label FROM reach JOIN pairs ON a = node WHERE label < b),
        comp AS (SELECT node AS vec_id, min(label) AS c FROM reach GROUP BY node)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM v LEFT JOIN links USING (vec_id) LEFT JOIN comp USING (vec_id)""",
}
