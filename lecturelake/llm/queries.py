"""The llm queries and their SQL: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, embeddings, licenses, media, mixing, quality, secrets, sentencepieces, simhash, substrings, suffixes, tries, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A public SentencePiece model; another path can be set in the environment.
PIECES = os.environ.get("LECTURELAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.tokens(_table(spark, sf_dir, "documents"), PIECES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_components(_table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.all_scores(_table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_table(spark, sf_dir, "documents")).drop("row")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepieces, op2_simhash, op3_embeddings, op4_secrets, op5_media, op6_mixing, op7_warc, op8_quality, op9_substrings, op10_licenses, op11_tries, op12_audit, op13_suffixes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.digests_sql(), "op6_mixing": mixing.mix_sql(), "op7_warc": warc.archive_sql(), "op10_licenses": licenses.labels_sql(), "op11_tries": tries.trie_sql(), "op12_audit": audit.audit_sql(), "op13_suffixes": suffixes.removal_sql()}
