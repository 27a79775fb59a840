"""From raw documents to token ids: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, exact_dedup, mixing, near_dedup, quality
from inkwell.llm.common import cut


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from these documents and the labels beside them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(cut(quality.featured(docs)), labels))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest id."""
    return exact_dedup.keep_rows(docs, exact_dedup.exact_duplicates(docs))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8): the one of the least id."""
    return near_dedup.keep_rows(docs, percent=80)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy; documents it does not take go."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and hashes of the ids and of what they decode to."""
    return bpe.encode_documents(docs, bpe.public_vocabulary(), with_ids=True, frugal=True)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("minhash near-dedup", unlike_documents),
    ("mixing", mixed_documents),
    ("byte-level bpe", encoded_documents),
]

#: Learned scores, MinHash and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
