"""The thin query of each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, pfor, quality_gam, quality_rules, simhash, token_count, toxicity, unigram, url_filter


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated runs of lines that have 50 words or more."""
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels outside the held-out fold."""
    return quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, robust distance and verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of fingerprints at 2 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files of blocks in ascending doc_id order and read back."""
    return pfor.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, learned from the labels outside the held-out fold."""
    return toxicity.score_severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Longest wins.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, by rule or by trees."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that stands in it."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the best path over the pieces, and decoded."""
    return unigram.round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_gam, op3_quality_rules, op4_token_counts, op5_simhash, op6_pfor_files, op7_toxicity, op8_url_filter, op9_decontamination, op10_unigram)}


def oracle_sql() -> dict[str, str]:
    return {}
