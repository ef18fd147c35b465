"""The corpus pipeline: quality, language, near duplicates, packing, each stage on what the one before kept.

Cases, by stage; every stage but the last returns its rows with all their columns, whatever they are named.
  null and empty texts: scored for quality as empty texts, then left out, as they have no letter.
  null ids: kept by all stages, never learned from, near duplicates of nothing; packed as rows without an id.
  very long texts: scored, parsed, compared and packed whole; cut into pieces of the capacity by packing alone.
  repeated rows: rows with one id are one document: if it stays all its rows stay, and each is packed.
  ties: of documents with equal texts the one with the least id stays.
  no labels: all documents have the score 0.5 and stay; no languages to learn: all documents with a letter stay.
  empty tables: no rows, with the columns of documents (the last stage's own columns at the end).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trustmill.llm import language, ngram_join, packing, quality
from trustmill.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more stay."""
    return quality.kept(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told stay."""
    return language.kept(docs, language.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of five-word shingles stays."""
    return ngram_join.representatives(docs, n=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the learned stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
