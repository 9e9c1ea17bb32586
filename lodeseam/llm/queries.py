"""The queries of this subpackage, each over the whole of its table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeseam.llm import chat, fingerprints, licenses, media, mixing, ngram_join, oracles, pii, quality, sentencepiece_bpe, sharding
from lodeseam.llm.base import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan_licenses(licenses.phrase_places(docs)))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "tail", "keep")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digest(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_calls(*chat.turns_as_calls(table(spark, sf_dir, "conversations")))


ALL = (
    op1_fingerprints, op2_pii, op3_license_scans, op4_ngram_jaccard_join, op5_mixing, op6_quality_classifier, op7_sharding, op8_sentencepiece, op9_media_columns,
    op10_chat_formatting,
)
QUERIES = {f.__name__: f for f in ALL}
ORACLE_SQL = {"op2_pii": oracles.pii_sql(), "op3_license_scans": oracles.license_sql(), "op4_ngram_jaccard_join": oracles.OP4, "op10_chat_formatting": oracles.OP10}
