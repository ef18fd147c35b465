"""The queries of this package: thin calls of the operators on whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trustmill.llm import alignment, backtracking, language, licences, media, ngram_join, packing, prefix_trie, quality, sentencepieces, token_files, toxicity, vectors
from trustmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, dictionary = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(blocks, dictionary).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtracking.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_files": op2_token_files,
        "op3_ngram_join": op3_ngram_join,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_media": op6_media,
        "op7_quality": op7_quality,
        "op8_licences": op8_licences,
        "op9_vectors": op9_vectors,
        "op10_packing": op10_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_alignment": op12_alignment,
        "op13_backtracking": op13_backtracking,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_licences": licences.oracle(), "op11_prefix_trie": prefix_trie.oracle()}
