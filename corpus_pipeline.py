"""The corpus pipeline: every stage works on all that the one before kept.

Documents of no id are documents like others; null texts count as empty and fail the quality rules, as empty texts do.
Repeated rows are copies, of which one stays. Columns beside those of ``documents`` stay up to the last stage, and an
empty table passes as an empty one. Texts are judged whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgraph.llm import bpe, decontamination, jaccard, quality, substrings
from mossgraph.llm.common import table, written
from mossgraph.llm.queries import PIECES, RANKS

#: Near duplicates of the pipeline: shingles of five words, and a similarity of 0.8 or more.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts, and those of fewer words than the rules ask for, are among them."""
    return quality.filtered(docs, [PIECES, RANKS], public_tokenizers.PATTERN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of the least id stays; texts without words all stay."""
    return jaccard.one_of_each(docs, NEAR_PERCENT, NEAR_SHINGLE)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what strings of 200 bytes that stand elsewhere too cover; every document stays, with n_chars of what is left."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark's item go; null and empty texts have none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of what is left; null texts have no tokens."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", bpe_coding),
]
#: Tokenisers and template slots have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
