"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import decontamination
from .fingerprints import fingerprints
from .mixing import mix_sql, mix_words
from .near_dup import near_duplicates
from .quality import quality
from .secrets import secrets
from .sharding import shard_documents, shard_sql
from .token_counts import token_counts
from .token_frames import token_files
from .toxicity import toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(table(spark, sf_dir, "documents")).drop("tie", "source")


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_frames": op1_token_frames, "op2_jump_shards": op2_jump_shards, "op3_weighted_sampling": op3_weighted_sampling, "op4_mix": op4_mix, "op5_dart_minhash": op5_dart_minhash, "op6_secrets": op6_secrets, "op8_tiling": op8_tiling, "op7_toxicity": op7_toxicity, "op9_quality": op9_quality, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {"op2_jump_shards": shard_sql(), "op4_mix": mix_sql()}
