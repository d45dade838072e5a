"""Filters, search, facets and view statistics over leads / listings.

All are narrow (per-row) predicates except the facet and stats aggregates, so
Catalyst pushes the column choice into the Parquet scan and evaluates them in
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import py_strip
from ..functions.patterns import SEARCH_COLUMNS, VIEW_COLUMNS, VIEW_DEFAULT
from ..functions.text import quote_regex

PHONE_MODES = ["all", "mobile", "landline", "has_phone", "no_phone"]


def not_blocked(listings: DataFrame, pattern: str | None,
                sources: tuple[str, ...] = ("google_maps",), enabled: bool = True) -> DataFrame:
    """Drop listings of ``sources`` whose raw name matches the blocklist
    pattern (case-insensitive substring of any entry). Off when disabled or
    when the pattern is None (empty list)."""
    if not enabled or pattern is None:
        return listings
    hit = F.col("source").isin(list(sources)) & F.coalesce(F.col("name"), F.lit("")).rlike(pattern)
    return listings.where(~hit)


GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none in a shorter text."""
    last = F.length(text) - n + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
                            .otherwise(F.array().cast("array<string>")))


def blocked_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``names`` (distinct lower-case ``name``) that contain an entry
    (``entry``), as a join: an entry is found through its rarest run of three
    characters (an entry of one or two through itself), then tested exactly. The
    list stays a frame of any length; a name is tested against the few entries
    whose run it holds, not against all."""
    e = entries.select(F.lower("entry").alias("entry")).where(F.trim("entry") != "").distinct()
    runs = e.where(F.length("entry") >= GRAM).select("entry", F.explode(_grams(F.col("entry"), GRAM)).alias("gram"))
    often = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = runs.join(often, "gram").groupBy("entry").agg(F.min(F.struct("n", "gram")).alias("k")).select("entry", F.col("k.gram").alias("gram"))
    keys = keys.unionByName(e.where(F.length("entry") < GRAM).select("entry", F.col("entry").alias("gram")))
    held = names.select("name", F.explode(F.concat(*[_grams(F.col("name"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    return held.join(keys, "gram").where(F.contains("name", "entry")).select("name").distinct()


def not_blocked_by(listings: DataFrame, entries: DataFrame, sources: tuple[str, ...] = ("google_maps",), enabled: bool = True) -> DataFrame:
    """``not_blocked`` for a blocklist of any length, given as a frame with
    ``entry``: drops listings of ``sources`` whose name contains an entry, compared
    in lower case. Blank entries block nothing; a NULL name is never blocked."""
    if not enabled:
        return listings
    of = F.col("source").isin(list(sources))
    blocked = blocked_names(listings.where(of).select(F.lower("name").alias("name")).where("name <> ''").distinct(), entries)
    return listings.join(blocked.select(F.col("name").alias("_blocked")), of & (F.lower(F.col("name")) == F.col("_blocked")), "left_anti")


def search_mask(query: str, columns=SEARCH_COLUMNS, literal: bool = False, present=None) -> Column | None:
    """Lower-cased query as a regex (or literal text) over lower-cased columns."""
    if not query:
        return None
    q = query.lower()
    pat = quote_regex(q) if literal else q
    cols = [c for c in columns if present is None or c in present]
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.lower(F.col(c)).rlike(pat), F.lit(False)) for c in cols],
                  F.lit(False))


def search(leads: DataFrame, query: str, literal: bool = False) -> DataFrame:
    m = search_mask(query, literal=literal, present=leads.columns)
    return leads if m is None else leads.where(m)


def no_phone(c: str = "phone") -> Column:
    return F.col(c).isNull() | (py_strip(F.col(c)) == "")


def phone_mask(mode: str) -> Column | None:
    if mode == "mobile":
        return F.col("phone_type") == "mobile"
    if mode == "landline":
        return F.col("phone_type") == "landline"
    if mode == "has_phone":
        return ~no_phone()
    if mode == "no_phone":
        return no_phone()
    if mode == "all":
        return None
    raise ValueError(f"unknown phone filter {mode!r}; expected one of {PHONE_MODES}")


def phone_filter(leads: DataFrame, mode: str) -> DataFrame:
    m = phone_mask(mode)
    return leads if m is None else leads.where(m)


def phone_modes(leads: DataFrame) -> DataFrame:
    """(mode, id) for every phone filter a lead passes, in one scan."""
    flags = F.array_compact(F.array(*[F.when(phone_mask(m), F.lit(m)) for m in PHONE_MODES[1:]]))
    return leads.select(F.explode(flags).alias("mode"), "id")


def source_filter(leads: DataFrame, source: str | None) -> DataFrame:
    """Literal substring of ``sources``."""
    return leads if not source else leads.where(F.col("sources").contains(source))


def tag_filter(leads: DataFrame, tag: str | None) -> DataFrame:
    """Literal substring of ``tags``."""
    return leads if not tag else leads.where(F.col("tags").contains(tag))


def view(leads: DataFrame, search_query: str = "", phone: str = "all", source: str | None = None,
         tag: str | None = None, literal: bool = False) -> DataFrame:
    """The results view: search -> phone -> source -> tag."""
    return tag_filter(source_filter(phone_filter(search(leads, search_query, literal), phone),
                                    source), tag)


def project(df: DataFrame, visible: list[str] | None = None) -> DataFrame:
    """``id`` plus the chosen visible columns that the frame has."""
    visible = visible or VIEW_DEFAULT
    unknown = [c for c in visible if c not in VIEW_COLUMNS]
    if unknown:
        raise ValueError(f"unknown view columns {unknown}")
    return df.select("id", *[c for c in visible if c in df.columns])


def view_stats(df: DataFrame) -> DataFrame:
    """showing / mobile / landline / no phone of a view (no-phone tests the
    phone text, the others test phone_type, so they need not add up)."""
    return df.agg(F.count(F.lit(1)).alias("showing"),
                  F.count_if(F.col("phone_type") == "mobile").alias("mobile"),
                  F.count_if(F.col("phone_type") == "landline").alias("landline"),
                  F.count_if(no_phone()).alias("no_phone"))


def source_facets(leads: DataFrame) -> DataFrame:
    """Sorted distinct names in the comma-split ``sources`` text."""
    parts = leads.select(F.explode(F.split(F.col("sources"), ",")).alias("s"))
    return (parts.select(py_strip("s").alias("source")).where(F.col("source") != "")
            .distinct().orderBy("source"))


def lead_count(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count(F.lit(1)).alias("leads"))
