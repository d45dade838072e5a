"""End-to-end flows a user runs: each reads snapshots, transforms, and writes
a new snapshot (the one being read is never overwritten).

A. collect -> merge -> save:  captured pages -> listings -> one row per
   company -> appended as a new session.
B. view -> act:               lazy filters -> dedupe / edit / tag.
C. verify website phones:     candidates x captured site pages -> phones.
D. import / export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as EX
from ..operators import links as LK
from ..operators import mutations as MU
from ..operators import verify as VF
from ..operators.filters import not_blocked
from ..operators.importer import import_counts, import_leads
from ..operators.merge import merge_listings, merge_summary
from ..schemas import conform_leads, conform_listings
from ..sources.blocklist import blocklist_pattern
from ..session import reliable_checkpoint
from ..sources.leads import marks_after
from ..sources.pages import newest

SOURCE_ORDER = ["google_maps", "jobstreet", "hiredly"]


def _ordered(df: DataFrame, source_no: int, order_cols: list[str]) -> DataFrame:
    """Listings of one source with ``ord`` = source block + rank in link order."""
    return MU.assign_ids(df, order_cols, source_no * 1_000_000_000_000, id_col="ord")


def listings_from_captured(pages: DataFrame, blocklist: str | list | None = None,
                           max_results: int | None = None, max_companies: int | None = None) -> DataFrame:
    """Captured pages -> listings in run order (map results, then directory A,
    then directory B; each in link order).

    pages: captured_pages (kind, source, seed_no, page_no, url, html, body_text).
    blocklist: the blocklist setting (JSON list text or a list); applied to
    map listings only, off when None or empty.
    """
    # every URL is visited once: the newest of its captures
    res = pages.where(F.col("kind").isin("maps_results", "dir_results"))
    det = newest(pages.where(F.col("kind").isin("maps_place", "dir_company")), "kind", "source", "url")

    maps_links = LK.place_links(res.where(F.col("source") == "google_maps"), max_results)
    maps_pages = det.where(F.col("source") == "google_maps").select("page_id", "url", "html")
    maps = (EX.place_details(maps_pages)
            .join(maps_links.select(F.col("href").alias("url"), "seed_no", "page_no", "pos"), "url")
            .select(F.lit("google_maps").alias("source"), "name", "phone", "website", "address",
                    "category", "rating", F.col("url").alias("google_maps_url"), "seed_no", "page_no", "pos"))
    maps = not_blocked(maps, blocklist_pattern(blocklist))

    a_links = LK.directory_a_links(res.where(F.col("source") == "jobstreet"))
    a_pages = det.where(F.col("source") == "jobstreet").select("page_id", "url", "body_text")
    a_fields = EX.label_fields(a_pages)
    dir_a = (a_links.join(a_fields, "url", "left")
             .select(F.lit("jobstreet").alias("source"), "name", "website", "address", "category",
                     "company_size", F.col("url").alias("jobstreet_url"), "seed_no", "page_no", "pos"))

    b_links = LK.directory_b_links(res.where(F.col("source") == "hiredly"), max_companies)
    b_pages = det.where(F.col("source") == "hiredly").select("page_id", "url", "html", "body_text")
    b_fields = EX.company_profile(b_pages)
    dir_b = (b_links.join(b_fields, "url")
             .select(F.lit("hiredly").alias("source"), "name", "website", "address", "category",
                     F.col("url").alias("hiredly_url"), "seed_no", "page_no", "pos"))

    order = ["seed_no", "page_no", "pos"]
    parts = [_ordered(df, i + 1, order).drop(*order) for i, df in enumerate([maps, dir_a, dir_b])]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(
        parts[2], allowMissingColumns=True)
    return conform_listings(out)


@dataclass
class RunResult:
    leads: DataFrame
    sessions: DataFrame
    summary: DataFrame
    new_leads: DataFrame
    marks: dict[str, int]


def collect_merge_save(spark: SparkSession, pages: DataFrame, leads: DataFrame, sessions: DataFrame,
                       requested: list[str], query_info: str, as_of, blocklist: str | None = None,
                       marks: dict[str, int] | None = None, **caps) -> RunResult | None:
    """Flow A. Returns None when the run found no listing (no session).
    ``marks``: the high-water marks stored with the current snapshot."""
    marks = marks or {}
    listings = reliable_checkpoint(listings_from_captured(pages, blocklist, **caps))
    if listings.limit(1).count() == 0:
        return None
    merged = reliable_checkpoint(merge_listings(listings))
    n = merged.count()
    sid = MU.next_id(sessions, marks.get("sessions"))
    sessions2 = MU.create_session(spark, sessions, requested, query_info, n, as_of, sid - 1)
    first = MU.next_id(leads, marks.get("leads"))
    new = MU.listings_as_leads(merged, sid, first, as_of)
    return RunResult(conform_leads(leads).unionByName(new), sessions2, merge_summary(merged), new,
                     {**marks, "leads": first + n - 1, "sessions": sid})


def verify_flow(leads: DataFrame, pages: DataFrame, as_of, scope: str = "unverified"):
    """Flow C over captured pages: (leads', results, metrics)."""
    results = reliable_checkpoint(VF.verify_captured(VF.website_candidates(leads, scope), pages))
    return VF.apply_site_phones(leads, results, as_of), results, VF.verify_metrics(leads, results)


def import_flow(file_df: DataFrame, leads: DataFrame, as_of, marks: dict[str, int] | None = None):
    """Flow D (import): (leads', counts, marks'). New rows get ids in file order."""
    marks = marks or {}
    new = reliable_checkpoint(import_leads(file_df, leads))
    rows = MU.assign_ids(new, ["ord"], MU.next_id(leads, marks.get("leads"))).drop("ord")
    rows = conform_leads(rows.withColumn("session_id", F.lit(None).cast("bigint")), as_of)
    out = conform_leads(leads).unionByName(rows)
    return out, import_counts(file_df, leads), marks_after(marks, leads=out)
