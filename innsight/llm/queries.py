"""Registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import bpe, crf, hard_negatives, hilbert, iblt, isolation, line_dedup, ngram_join, packing, surrogates, token_files, toolcalls, whitening
from innsight.llm.common import read, with_running_total
from innsight.session import staging_dir

SHARDS = 8
SEQUENCE = 2048
KEY = "corpus-surrogates-1"  # in production a secret of the deployment


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = hilbert.hilbert_shards(
        docs, ["source", "lang", "n_chars"], SHARDS, ["doc_id", "text_crc32", "size"],
        ["doc_id", "source", "lang", "n_chars", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = toolcalls.messages_of(read(spark, sf_dir, "conversations"))
    return toolcalls.link_tool_calls(messages).withColumn("errors", F.to_json("errors"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = isolation.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return crf.extract(pages, crf.fit(pages))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(read(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_entities")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), words=5, percent=80)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = f"{staging_dir(spark)}/llm-token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    back = token_files.read_token_files(spark, path, digest=True)
    return with_running_total(back, ["doc_id", "n_tokens", "ids_crc32"], F.col("n_tokens"), "start", "token-starts").select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=SEQUENCE)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(read(spark, sf_dir, "documents"), iblt.part_digests).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited_text", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & whitening.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("x")), F.col("vec_id") % 100 == 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_frequent_lines(read(spark, sf_dir, "documents"), least=10)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1,
    "op2_tool_call_linking": op2,
    "op3_isolation_forest": op3,
    "op4_crf_main_text": op4,
    "op5_pii_surrogates": op5,
    "op6_ngram_jaccard_join": op6,
    "op7_token_files": op7,
    "op8_best_fit_packing": op8,
    "op9_bpe": op9,
    "op10_iblt_fingerprints": op10,
    "op11_hard_negatives": op11,
    "op12_line_dedup": op12,
    "op13_whitening": op13,
}

ORACLE: dict[str, str] = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
single AS (SELECT doc_id, unnest(s) AS g FROM sets),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM single a JOIN single b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM overlap JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION SELECT reach.d, ways.y FROM reach JOIN ways ON reach.r = ways.x)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach ON d = sizes.doc_id GROUP BY sizes.doc_id, n
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
    "op12_line_dedup": """
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
keyed AS (
  SELECT r, doc_id, w, list_transform(w, lambda l: translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k
  FROM lines),
single AS (SELECT r, unnest(list_distinct(k)) AS key FROM keyed),
frequent AS (SELECT key FROM single WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
place AS (SELECT r, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS key FROM keyed),
gone AS (SELECT r, list(i) AS g FROM place WHERE key IN (SELECT key FROM frequent) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(g, []), i)), lambda i: w[i]), chr(10))) AS kept_sha256
FROM keyed LEFT JOIN gone USING (r)
""",
}
