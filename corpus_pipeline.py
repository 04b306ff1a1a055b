"""The corpus pipeline: documents in, token ids out, one stage after the other.

Each stage takes the documents that the one before kept.  All but the last return the columns of documents.  Rows are documents,
whether their doc_id is null, repeated or neither.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm import bpe, jaccard, mixing, quality, toxicity
from ringside.llm.common import free_name, materialize, read_table

#: Not expressible in SQL (trained models, byte-pair merges); tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None

#: A document is good from this probability on, and toxic from this one.
GOOD, TOXIC = 0.7, 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    model, score = quality.fit(docs, read_table(spark, sf_dir, "labels")), free_name("__score", docs)
    return quality.score(docs, model, out=score).filter(F.col(score) >= GOOD).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough evidence of toxic passages."""
    model, found = toxicity.fit(docs, read_table(spark, sf_dir, "labels")), free_name("__toxic", docs)
    return toxicity.with_scan(docs, model, out=found).filter(F.col(found)["score"] < TOXIC).drop(found)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by five-word shingle sets of similarity 0.8, the one with the smallest id."""
    return jaccard.representatives(docs, words=5, threshold=(80, 100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and how many."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
