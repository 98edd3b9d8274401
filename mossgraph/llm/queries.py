"""The queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, jaccard, licenses, merkle, quality, quality_model, sharding, substrings, toxicity, warc, whitening
from .common import shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.bytes_per_document(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.per_document(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.per_document(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.compacted(spark, table(spark, sf_dir, "documents"), shared_dir(spark))


def op8_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.words_per_document(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), [PIECES, RANKS], public_tokenizers.PATTERN).drop("text", "lang")


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.per_document(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.per_component(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_warc, op2_suffix_dedup, op3_licenses, op4_toxicity, op5_jaccard, op6_decontamination, op7_sharding, op8_anchor_dedup, op9_bpe, op10_quality, op11_quality_model, op12_merkle, op13_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op3_licenses": licenses.oracle(), "op5_jaccard": jaccard.ORACLE, "op7_sharding": sharding.ORACLE, "op8_anchor_dedup": substrings.WORDS_ORACLE, "op12_merkle": merkle.ORACLE}
