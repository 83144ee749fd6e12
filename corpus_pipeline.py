"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, secrets, token ids.

Every stage takes its predecessor's whole table and keeps the columns of documents, whatever others there are,
but the last, which has columns of its own. A null or empty text is scored by the classifier as such, has no near
duplicates, leaks nothing, has no secrets and no tokens; a null text stays null. A null doc_id is carried, and
comes after all others where the least of a class stays; of repeated rows one stays, ties are told apart by the
text's hash. An empty table stays empty through all stages. Without labels, the classifier rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe_stream, byte_cnn, ngram_join, qgram_filter, secret_scan
from tidelog.llm._shared import stored

#: SQL can't express the classifier, so run() is tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts."""
    return byte_cnn.keep_good(docs, byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return qgram_filter.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and digests of its ids and of the decoded text."""
    return bpe_stream.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("bpe encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the table that its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
