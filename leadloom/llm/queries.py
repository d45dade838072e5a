"""The registered queries of the training-data operators: thin wrappers that
derive each contract's columns from the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, centroids, decontam, fracsketch, langid, mixture, packing, sharding, sitequality, suffixtree, superkmer, warc, whitening
from .common import table
from .oracles import ORACLES


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.report(table(spark, sf_dir, "documents"))


def op2_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_fracminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fracsketch.report(table(spark, sf_dir, "documents"))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffixtree.score(docs, ~suffixtree.held_out())


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitequality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_rotated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_best_fit_shards": op2_best_fit_shards,
    "op3_fracminhash": op3_fracminhash,
    "op4_capture_index": op4_capture_index,
    "op5_super_kmers": op5_super_kmers,
    "op6_decontamination": op6_decontamination,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_site_quality": op8_site_quality,
    "op9_language_id": op9_language_id,
    "op10_bagminhash": op10_bagminhash,
    "op11_sainte_lague": op11_sainte_lague,
    "op12_exact_whitening": op12_exact_whitening,
    "op13_rotated_filter": op13_rotated_filter,
}

__all__ = ["ORACLES", "QUERIES"]
