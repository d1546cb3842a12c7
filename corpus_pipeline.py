"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what `run` gives is the last one's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, line_dedup, quality_rules, simhash, unigram
from larkspur.llm.common import Scratch
from larkspur.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without later copies of repeated runs of lines; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    return left.select(*(F.when(F.col("__lk_cuts").isNull(), F.col(c)).otherwise(F.char_length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is in."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each document's pieces."""
    return unigram.encode_documents(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: No stage but the first can be told in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read again as the next one's."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = len(Scratch.opened)
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        Scratch.end_since(mark)  # what the stage itself kept, and what it read
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
