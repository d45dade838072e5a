"""From raw documents to packed training sequences.

Five stages, each an operator of ``leadloom.llm``: texts without a recognised
language go, one document of each near-duplicate class stays, passages that
repeat are cut, benchmark passages are cut (documents that are mostly benchmark
go), and the rest is packed into sequences. Every stage reads the table that
the one before it wrote. Null or empty texts do not pass the first stage; an
empty table gives empty tables. ``ORACLE_SQL`` is None: SQL expresses neither
a trained network nor verified LSH classes; ``tests/llm`` compares the stages
with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bagminhash, decontam, langid, packing, superkmer
from leadloom.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return superkmer.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
