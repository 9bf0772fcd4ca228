"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, exact_dedup, language, mixing, passages, periods, quality, secret_scan, sharding, simhash, token_counts, topk
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_MODEL = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
QUALITY_FROM = 0.3
TOPK_EVERY = 100
TOPK = 10
SHARDS = 40
CLUSTERS = 40
CLUSTER_ROUNDS = 5
SIMHASH_SHINGLE = 4
SIMHASH_BITS = 4


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY_FROM)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digests(table(spark, sf_dir, "embeddings"), TOPK_EVERY, TOPK)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabularies.path(BPE_RANKS), vocabularies.PATTERN)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), vocabularies.path(COUNT_MODEL), TOKEN_LIMIT)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_BITS)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"), SHARDS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digests(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_passages": op1_passages,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periods": op11_periods,
    "op12_secrets": op12_secrets,
    "op13_clustering": op13_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op1_passages": passages.ORACLE,
    "op3_topk": topk.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_clustering": clustering.oracle(CLUSTERS, CLUSTER_ROUNDS),
}
