"""Explicit schemas of the lead tables (all text columns are STRING, absent
values are '' rather than NULL; only ``session_id`` may be NULL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, TS = T.StringType(), T.LongType(), T.TimestampType()

LISTING_TEXT = ["source", "name", "phone", "website", "address", "category",
                "company_size", "rating", "google_maps_url", "jobstreet_url", "hiredly_url"]
LISTINGS = T.StructType([T.StructField("ord", L, False)] +
                        [T.StructField(c, S) for c in LISTING_TEXT])

LEAD_TEXT = ["name", "phone", "phone_type", "website", "website_phone", "website_phone_type",
             "website_phone2", "website_phone2_type", "address", "category", "company_size",
             "rating", "sources", "google_maps_url", "jobstreet_url", "hiredly_url", "tags",
             "notes"]
LEADS = T.StructType([T.StructField("id", L, False)] +
                     [T.StructField(c, S) for c in LEAD_TEXT] +
                     [T.StructField("session_id", L, True), T.StructField("created_at", TS),
                      T.StructField("updated_at", TS)])
LEAD_COLUMNS = [f.name for f in LEADS.fields]

SESSIONS = T.StructType([T.StructField("id", L, False), T.StructField("sources", S),
                         T.StructField("query_info", S), T.StructField("result_count", L),
                         T.StructField("created_at", TS)])
TAGS = T.StructType([T.StructField("id", L, False), T.StructField("name", S),
                     T.StructField("color", S), T.StructField("created_at", TS)])
WEBSITE_PHONES = T.StructType([T.StructField("id", L, False)] +
                              [T.StructField(c, S) for c in
                               ["website_phone", "website_phone_type", "website_phone2",
                                "website_phone2_type", "website_phone_source"]] +
                              [T.StructField("all_phones", T.ArrayType(S))])


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select ``schema``'s columns in order; missing text columns become '',
    NULL text becomes '', other missing columns take ``defaults`` or NULL."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
            if isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit(""))
        elif f.name in defaults:
            c = F.lit(defaults[f.name]).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = F.lit("")
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def conform_listings(df: DataFrame) -> DataFrame:
    if "ord" not in df.columns:
        raise ValueError("listings need an explicit 'ord' column (row order decides)")
    return conform(df, LISTINGS)


def conform_leads(df: DataFrame, as_of=None) -> DataFrame:
    ts = {"created_at": as_of, "updated_at": as_of} if as_of is not None else {}
    return conform(df, LEADS, ts)
