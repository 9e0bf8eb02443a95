"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duotext.llm import (
    bpe, collisions, fingerprints, knn_quality, lexical, maxent, mixing, repetition, resampling, secret_spans, simhash, token_counts, url_rules,
)
from duotext.llm.texts import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Host, path and verdict of the rules that op4 applies.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


@query
def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir))


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


@query
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.scan(documents(spark, sf_dir))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
