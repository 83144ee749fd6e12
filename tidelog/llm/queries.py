"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidelog.llm import bpe_stream, byte_cnn, license_join, lz_fingerprint, ngram_join, qgram_filter, rank_merge, secret_scan, simple8b, warc_normaliser


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normaliser.archive_round_trip(_table(spark, sf_dir, "pages"))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_merge.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, _table(spark, sf_dir, "labels")))


def op6_qgram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_filter.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_normaliser, op2_simple8b, op3_lz_fingerprint, op4_rank_merge, op5_byte_cnn, op6_qgram_filter, op7_license_join, op8_ngram_join, op9_bpe_stream, op10_secret_scan)} | {"pipeline": corpus_pipeline.run}

ORACLE = {
    "op1_warc_normaliser": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
        FROM h
    """,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
