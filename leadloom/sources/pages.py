"""Captured pages: the stand-in for live page fetches.

``captured_pages(page_id, kind, source, seed_no, page_no, url, company_id,
html, body_text)`` holds pages already fetched; ``kind`` is one of
maps_results, maps_place, dir_results, dir_company, site_home, site_contact.
Every extraction job is a Spark job over this table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["maps_results", "maps_place", "dir_results", "dir_company", "site_home", "site_contact"]

CAPTURED_PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("seed_no", T.LongType()),
    T.StructField("page_no", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("company_id", T.LongType()), T.StructField("html", T.StringType()),
    T.StructField("body_text", T.StringType())])


def read_captured(spark: SparkSession, path: str, kind: str | None = None,
                  source: str | None = None) -> DataFrame:
    """Scan captured pages; the kind / source filters push into the scan."""
    df = spark.read.schema(CAPTURED_PAGES).parquet(path)
    if kind:
        df = df.where(F.col("kind") == kind)
    if source:
        df = df.where(F.col("source") == source)
    return df


def newest(pages: DataFrame, *keys: str) -> DataFrame:
    """Of the captures that agree on ``keys``, the one with the highest
    page_id (unique). Only the narrow (keys, page_id) rows are aggregated."""
    last = pages.groupBy(*keys).agg(F.max("page_id").alias("page_id")).select("page_id")
    return pages.join(last, "page_id").select(*pages.columns)
