"""A pipeline for training data: quality rules, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet to the shared folder and read again as the
next stage's docs. All stages but the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import mixing, near_texts, pii_weak, quality_mcd, sentencepiece_offsets
from threadloom.llm.common import cut
from threadloom.llm.queries import model_path, source_domains

#: Near copies: words of a shingle, similarity in percent, and bits by which linked fingerprints may differ.
WORDS, PERCENT, RADIUS = 5, 80, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their language and source."""
    return quality_mcd.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest id: linked by the fingerprints' index or by shared least shingles, and similar by their whole sets."""
    return near_texts.keep_one(docs, words=WORDS, percent=PERCENT, radius=RADIUS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by the kind's name."""
    masked = pii_weak.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mixture's weights, each as often as it was drawn."""
    return mixing.draw(docs, source_domains(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends, decoded."""
    return sentencepiece_offsets.encode_texts(docs, model_path())


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The outlier estimates and the span classifier are iterative; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
