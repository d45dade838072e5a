"""Link extraction from captured result pages (L1-L4).

Anchors are exploded per page (narrow), then one hash aggregation per URL
keeps the first occurrence in (seed, page, position) order. All links are
returned; a results limit applies only where the caller passes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import anchors, attr, inner_text, markup, resolve_url
from ..functions.patterns import (CONTACT_HREF_ACCEPT, CONTACT_HREF_HINTS, CONTACT_SKIP,
                                  CONTACT_TEXT_ACCEPT, CONTACT_TEXT_HINTS, DIR_A_BASE,
                                  DIR_A_SKIP_NAMES, DIR_B_BASE)
from ..functions.text import clean_line
from ..functions.tree import attrs_of, opened, pieces, with_elements


def exploded_anchors(pages: DataFrame, keep=("seed_no", "page_no")) -> DataFrame:
    """(keep..., pos, href, text) per anchor. Both are computed before the
    explode, so that filters on them find finished columns."""
    def link(a):
        return F.struct(attr(a.attrs, "href").alias("href"), inner_text(a.inner).alias("text"))
    a = pages.select(*keep, F.posexplode(F.transform(anchors(markup("html")), link)).alias("pos", "a"))
    return a.select(*keep, "pos", "a.href", "a.text")


def _first_seen(df: DataFrame, key: str, order=("seed_no", "page_no", "pos"), carry=()) -> DataFrame:
    first = F.min(F.struct(*order, *carry)).alias("_first")
    g = df.groupBy(key).agg(first)
    return g.select(key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *carry)])


def _first_n(links: DataFrame, n: int | None) -> DataFrame:
    return links if n is None else links.orderBy("seed_no", "page_no", "pos").limit(n)


def _feed(p) -> Column:
    """True for the start tag of a div of role feed."""
    return opened(p, "div") & p.contains("feed") & (attr(attrs_of(p), "role") == "feed")


def feed_links(pages: DataFrame, keep=("seed_no", "page_no")) -> DataFrame:
    """(keep..., pos, href) of the links that are children of children of divs of
    a feed, in document order."""
    df = pages.select(*keep, F.col("html").alias("_h")).withColumn("_h", markup("_h"))
    df = df.withColumn("_p", F.when(F.col("_h").contains("feed"), pieces("_h")))
    # what is before the first feed has no part in it
    df = df.withColumn("_f", F.array_position(F.transform("_p", lambda p: _feed(p)), True).cast("int")).where("_f > 0")
    df = df.withColumn("_p", F.concat(F.array(F.lit("")), F.slice("_p", F.col("_f"), F.size("_p"))))
    df = with_elements(df, "_e", "_p", parent=lambda p: opened(p, "a"), mark=lambda p: F.when(_feed(p), "F").otherwise(""))
    inside = F.filter("_e", lambda e: e.path.rlike(r">div:[0-9]+F[^>]*>div:[0-9]+[^>]*>div:[0-9]+[^>]*$"))
    df = df.withColumn("_n", F.sort_array(F.flatten(F.transform(inside, lambda e: e.wanted))))
    hrefs = F.transform("_n", lambda n: attr(attrs_of(F.get("_p", n)), "href"))
    return df.select(*keep, F.posexplode(hrefs).alias("pos", "href"))


def place_links(result_pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """Map-place links of the result feed: hrefs containing '/maps/place/',
    first-seen distinct across seeds; with ``max_results`` the first of them in
    order. ``pos`` counts the feed's links."""
    a = feed_links(result_pages).where(F.col("href").contains("/maps/place/"))
    return _first_n(_first_seen(a, "href"), max_results)


def directory_a_links(result_pages: DataFrame, base: str = DIR_A_BASE) -> DataFrame:
    """(name, url) of directory-A company links: name = stripped text, then
    non-ASCII removed; skip fixed non-names, names shorter than 2 and
    '/companies?' hrefs; absolute URL cut at '?'; first-seen per URL."""
    a = exploded_anchors(result_pages).where(F.col("href").contains("/companies/"))
    a = a.withColumn("name", clean_line("text"))
    a = a.where(~F.lower("name").isin(DIR_A_SKIP_NAMES) & (F.length("name") >= 2)
                & ~F.col("href").contains("/companies?"))
    absolute = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(
        F.concat(F.lit(base), F.col("href")))
    a = a.withColumn("url", F.split(absolute, r"\?").getItem(0))
    return _first_seen(a, "url", carry=("name",)).select("name", "url", "seed_no", "page_no", "pos")


def directory_b_links(result_pages: DataFrame, max_companies: int | None = None,
                      base: str = DIR_B_BASE) -> DataFrame:
    """Directory-B company URLs: '/companies/' but not '/companies?'; made
    absolute; first-seen per absolute URL; with ``max_companies`` the first."""
    a = exploded_anchors(result_pages).where(
        F.col("href").contains("/companies/") & ~F.col("href").contains("/companies?"))
    a = a.withColumn("url", F.when(F.col("href").startswith("http"), F.col("href"))
                     .otherwise(F.concat(F.lit(base), F.col("href"))))
    return _first_n(_first_seen(a, "url"), max_companies)


def _any_contains(c, words) -> "F.Column":
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def contact_links(home_pages: DataFrame, key: str = "company_id") -> DataFrame:
    """First contact-page link of each home page, resolved against its URL.

    Candidates (document order): href containing one of the href hints
    (case-sensitive) or text containing 'contact' / 'hubungi' (any case).
    Hrefs naming a social site, mailto: or tel: are skipped. A candidate is
    taken when its text says contact/hubungi/reach, else when its href says
    contact/hubungi. Pages without one yield no row; when the first accepted
    link has an empty href there is no contact page (``contact_url`` NULL)."""
    a = exploded_anchors(home_pages, keep=(key, "url"))
    text = F.lower("text")
    href = F.col("href")
    hl = F.lower(href)
    candidate = (_any_contains(href, CONTACT_HREF_HINTS)
                 | _any_contains(text, [t.lower() for t in CONTACT_TEXT_HINTS]))
    accept = _any_contains(text, CONTACT_TEXT_ACCEPT) | _any_contains(hl, CONTACT_HREF_ACCEPT)
    ok = a.where(candidate & ~_any_contains(hl, CONTACT_SKIP) & accept)
    first = ok.groupBy(key).agg(F.min(F.struct("pos", "href", "url")).alias("f"))
    return first.select(key, F.col("f.pos").alias("pos"), F.col("f.href").alias("href"),
                        F.when(F.col("f.href") == "", F.lit(None).cast("string"))
                        .when(F.col("f.href").startswith("http"), F.col("f.href"))
                        .otherwise(resolve_url(F.col("f.url"), F.col("f.href"))).alias("contact_url"))
