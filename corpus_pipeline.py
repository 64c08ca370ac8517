"""A corpus pipeline of five operators over ``documents``; each stage is written and read again by the next."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import jaccard, packing, quality, secrets, toxicity
from newsloom.llm.common import table
from newsloom.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of toxic and ordinary texts call toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike the trusted ones go."""
    return quality.keep_good(docs, quality.trusted_texts(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles at 0.8, five words each, the one with the smallest id stays."""
    return jaccard.one_of_each(docs, share=80, words=5, rare_first=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and the lengths follow."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # models, hashes and token ids; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = settle(spark, partial(step, spark, docs, sf_dir), name)
    return docs
