"""Cleaning of a training corpus: each stage is written as Parquet and read by the next.

toxicity (rejected documents go), line dedup (later near-copies of lines go), near
duplicates (one document of each group stays), benchmark decontamination (documents
that hold a test item go), and byte-level BPE encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from wardlight.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; rows that repeat an id are judged one by one."""
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, index)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that come close to an earlier line; n_chars follows the text."""
    kept = line_dedup.remove_repeats(docs).drop("n_removed")
    changed = F.coalesce(F.length("text"), F.col("n_chars"))
    return kept.withColumn("n_chars", changed.cast("bigint")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of each document."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                     public_tokenizers.PATTERN, outputs=("n_tokens", "ids"))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near duplicates", near), ("decontamination", leaks),
          ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
