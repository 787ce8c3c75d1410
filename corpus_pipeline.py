"""A training corpus from ``documents``: filtered, deduplicated, free of secrets and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; the caller writes its result and reads
it again for the next. Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import passagework
from passagework.lineage import cut
from passagework.llm import exact_dedup, jaccard_join, packing, quality, secrets
from passagework.shipping import ship

#: Near duplicates share this many percent of their distinct n-grams of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _ship(spark: SparkSession) -> None:
    ship(spark, os.path.dirname(os.path.abspath(passagework.__file__)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.5 go. The classifier learns from the labels of ``sf_dir``."""
    _ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the one with the smallest doc_id stays."""
    _ship(spark)
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays."""
    _ship(spark)
    return jaccard_join.drop_similar(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text and ``n_chars`` counts anew; all other texts stay as they are."""
    _ship(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids; see ``packing.pack``."""
    _ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("exact dedup", no_copies), ("n-gram Jaccard join", no_near_copies),
          ("secret scans", no_secrets), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = cut(docs)
    return docs
