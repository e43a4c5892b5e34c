"""From documents to token ids: quality, copies, benchmark passages, personal data, tokens.

Each stage is a function of (spark, docs, folder of tables) that returns what it keeps, and works on all that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import telewatch
from telewatch.llm import bpe, decontaminate, neardup, pii, quality
from telewatch.llm.common import load, prepare
from telewatch.sources.tables import materialise


# task functions travel with the plan, so workers need not have the package on their path
cloudpickle.register_pickle_by_value(telewatch)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, fitted on the labels outside the held-out fold, accepts."""
    prepare(spark)
    return quality.good(docs, quality.fit(docs, load(spark, sf_dir, "labels"), quality.in_fold()))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near-duplicates: five words, similarity 0.8."""
    prepare(spark)
    return neardup.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    prepare(spark)
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and ids (little-endian uint32) of every document."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "n_chars"])
    return out.selectExpr("doc_id", "lang", "source", "n_chars", "cast(octet_length(ids) / 4 as long) AS n_tokens", "ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("near_duplicates", without_copies),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None  # SQL has no such classifier; the rows are tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
