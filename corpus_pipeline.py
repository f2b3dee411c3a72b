"""A training corpus from the documents: the stages, and their run one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.llm import bpe, jaccard, language, mixing, pii, queries
from termtide.llm.common import crc_bucket, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; learns as the query does."""
    labelled = docs.select("doc_id", "text", "lang").where(crc_bucket("doc_id", 5) != 0)
    return language.predict(docs, language.learn(labelled), drop_rejected=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents keep the one with the smallest doc_id."""
    return jaccard.first_of_groups(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the text; n_chars follows."""
    return pii.redacted(docs, n_chars="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix does: not at all, or one to three times."""
    return mixing.taken(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and the text as decoded from the ids."""
    path, pattern = queries.vocabulary()
    return bpe.round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
        F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# Language and token ids are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
