"""Website phone verification over captured company pages.

Plan: candidates (leads with a website) join their captured home / contact
pages on the company id. Each page yields phone hits from three strategies
(tel: links, chat links, text with context) by exploding regex matches
(narrow). Hits reduce per (company, phone) with one hash aggregation, then per
company with a second one that keeps the ranked list of that company's
distinct numbers, which is bounded by what its two pages contain. Results
update the leads with a left join on the unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (CHAT_PHONE_RE, TEXT_PHONE_RE, classify_phone, is_fax_context,
                         is_valid_phone, normalize_phone, text_phone_confidence)
from ..functions.html import anchors, attr, markup, strip_tags
from .links import contact_links
from ..sources.pages import newest
from ..functions.patterns import CHAT_HINTS, CONTEXT_AFTER, CONTEXT_BEFORE
from ..functions.text import blank, let
from ..functions.tree import attrs_of, markup_of, opened, pieces, with_elements



def conf_rank(c) -> Column:
    """high 0, medium 1, low 2."""
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)

# Phones that a window can reach over: each has nine characters or more.
REACH_BEFORE, REACH_AFTER = -(-CONTEXT_BEFORE // 9), -(-CONTEXT_AFTER // 9)

# ------------------------------------------------------------------ V1, V2, V10


def website_candidates(leads: DataFrame, scope: str = "all") -> DataFrame:
    """Leads whose website starts with 'http' in any letter case (the stored
    query's LIKE ignores ASCII case), in id order at the sink. ``scope``:
    'all' or 'unverified' (empty website_phone)."""
    c = leads.where(F.lower(F.col("website")).startswith("http")).select(
        "id", "name", "phone", "website", "website_phone")
    if scope == "unverified":
        return c.where(F.coalesce(F.col("website_phone"), F.lit("")) == "")
    if scope != "all":
        raise ValueError("scope is 'all' or 'unverified'")
    return c


def checkable(candidates: DataFrame) -> DataFrame:
    """The checker itself re-tests the prefix case-sensitively."""
    return candidates.where(F.col("website").startswith("http"))


def verify_metrics(leads: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """has website / verified / not verified; with ``results``: checked /
    found / saved (saved = results with a phone)."""
    c = website_candidates(leads)
    base = c.agg(F.count(F.lit(1)).alias("has_website"),
                 F.count_if(F.coalesce(F.col("website_phone"), F.lit("")) != "").alias("verified"))
    base = base.withColumn("not_verified", F.col("has_website") - F.col("verified"))
    if results is None:
        return base
    c_rows = c.select((F.coalesce(F.col("website_phone"), F.lit("")) != "").alias("v"),
                      F.lit(None).cast("boolean").alias("f"))
    r_rows = results.select(F.lit(None).cast("boolean").alias("v"),
                            (F.col("website_phone") != "").alias("f"))
    u = c_rows.unionByName(r_rows)
    return u.agg(F.count("v").alias("has_website"), F.count_if(F.col("v")).alias("verified"),
                 (F.count("v") - F.count_if(F.col("v"))).alias("not_verified"),
                 F.count("f").alias("checked"), F.count_if(F.col("f")).alias("found"),
                 F.count_if(F.col("f")).alias("saved"))


# ------------------------------------------------------------------ V3-V5 per page

HIT = "struct<strategy:int,pos:bigint,raw:string,confidence:string>"


def _hit(strategy: int, pos: Column, raw: Column, confidence: Column) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), pos.cast("bigint").alias("pos"),
                    raw.alias("raw"), confidence.alias("confidence"))


def _none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _tel(p) -> Column:
    """True for the start tag of a tel: link."""
    return opened(p, "a") & p.contains("tel:") & attr(attrs_of(p), "href").startswith("tel:")


def with_tel_hits(pages: DataFrame, html: str, name: str = "_tels") -> DataFrame:
    """Adds the tel: links in document order; a link whose parent element's text
    mentions fax is skipped; 'tel:' and '%20' removed; confidence high."""
    # most pages hold no tel link and are not taken apart
    df = with_elements(pages.withColumn("_p", F.when(F.col(html).contains("tel:"), pieces(html))), "_e", "_p", parent=_tel)
    around = F.transform("_e", lambda e: F.struct(e.wanted.alias("wanted"), strip_tags(markup_of(F.col("_p"), e)).alias("text")))
    df = df.withColumn("_n", F.sort_array(F.flatten(F.transform(F.filter(around, lambda e: ~is_fax_context(e.text)), lambda e: e.wanted))))
    raw = lambda n: F.replace(F.replace(attr(attrs_of(F.get("_p", n)), "href"), F.lit("tel:"), F.lit("")), F.lit("%20"), F.lit(""))
    hits = F.transform("_n", lambda n: _hit(1, n, raw(n), F.lit("high")))
    return df.withColumn(name, F.coalesce(hits, _none())).drop("_p", "_e", "_n")


def chat_array(html) -> Column:
    """Chat links (wa.me / whatsapp / wasap in the href): the first mobile
    number in the href; confidence high."""
    def hinted(t):
        out = F.lit(False)
        for h in CHAT_HINTS:
            out = out | t.href.contains(h)
        return out
    hrefs = F.transform(anchors(html), lambda a, ai: F.struct(ai.alias("ai"),
                                                              attr(a.attrs, "href").alias("href")))
    hits = F.transform(F.filter(hrefs, hinted),
                       lambda t: _hit(2, t.ai, F.regexp_extract(t.href, CHAT_PHONE_RE, 1), F.lit("high")))
    some = F.lit(False)
    for h in CHAT_HINTS:
        some = some | F.col(html).contains(h)
    return F.when(some, F.filter(hits, lambda h: h.raw != "")).otherwise(_none())


def window_matches(text) -> Column:
    """array<struct<pre, raw, post>> of every non-overlapping text phone with
    up to 60 characters before and 20 after. The text is cut at its phones once;
    a phone has nine characters at least, so a window is made of the pieces next
    to it, however long the text and however many its phones."""
    none = F.array().cast("array<struct<pre:string,raw:string,post:string>>")

    def found(x):
        def windows(gaps):
            def piece(j):
                return F.concat(F.get(gaps, j), F.coalesce(F.get(x.raws, j), F.lit("")))

            def one(raw, i):
                before = F.transform(F.sequence(F.greatest(i - REACH_BEFORE, F.lit(0)), i), lambda j: F.when(j < i, piece(j)).otherwise(F.get(gaps, j)))
                after = F.transform(F.sequence(i + 1, F.least(i + REACH_AFTER, F.size(gaps) - 1)), piece)
                return F.struct(F.right(F.array_join(before, ""), F.lit(CONTEXT_BEFORE)).alias("pre"), raw.alias("raw"),
                                F.left(F.array_join(after, ""), F.lit(CONTEXT_AFTER)).alias("post"))
            return F.transform(x.raws, one)
        return F.when(F.size(x.raws) > 0, let(F.split(x.t, TEXT_PHONE_RE), windows)).otherwise(none)

    t = blank(text)
    return let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(TEXT_PHONE_RE), 1).alias("raws")), found)


def with_text_hits(pages: DataFrame, text: Column, name: str = "_texts") -> DataFrame:
    """Adds the text phones: fax in the window -> skipped; a context word ->
    medium, else low."""
    df = pages.withColumn("_w", window_matches(text))
    ctx = F.transform("_w", lambda m, i: F.struct(F.concat(m.pre, m.raw, m.post).alias("ctx"), i.alias("i"), m.raw.alias("raw")))
    hits = F.transform(F.filter(ctx, lambda x: ~is_fax_context(x.ctx)), lambda x: _hit(3, x.i, x.raw, text_phone_confidence(x.ctx)))
    return df.withColumn(name, hits).drop("_w")


def _explode_hits(pages: DataFrame, arr: Column, key: str) -> DataFrame:
    return (pages.select(key, "page_ord", F.explode(arr).alias("h"))
            .select(key, "page_ord", "h.strategy", "h.pos", "h.raw", "h.confidence"))


def text_phones(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text phones with their context windows (no fax filtering): key, pos,
    raw match and the context text."""
    h = docs.select(key, F.posexplode(window_matches(F.col(text))).alias("pos", "m"))
    return h.select(key, "pos", F.col("m.raw").alias("raw"),
                    F.concat("m.pre", "m.raw", "m.post").alias("context"))


def page_hits(pages: DataFrame, key: str = "company_id") -> DataFrame:
    """All strategies of every page in one scan, in strategy order, normalised
    and validated. A page without captured text gives its markup's text. Pages
    of no company (NULL key) give no hit."""
    page = pages.where(F.col(key).isNotNull()).select(key, "page_ord", markup("html").alias("_h"), "body_text")
    page = with_tel_hits(page, "_h").withColumn("_chats", chat_array("_h"))
    page = with_text_hits(page, F.coalesce(F.col("body_text"), strip_tags("_h")))
    hits = _explode_hits(page, F.concat("_tels", "_chats", "_texts"), key)
    n = normalize_phone("raw")
    return (hits.withColumn("phone", n).where(is_valid_phone(F.col("phone")))
            .select(key, "page_ord", "strategy", "pos", "phone", "confidence"))


# ------------------------------------------------------------------ V6-V8


def company_phones(pages: DataFrame, key: str = "company_id") -> DataFrame:
    """(company, phone, confidence, order) after the per-page first-seen rule
    and the home + contact fold.

    Per page a number keeps the confidence of its first hit (strategy order,
    then position). Across pages the home page's confidence stays unless the
    contact page says high; a number seen on both keeps its home position."""
    return phones_from_hits(page_hits(pages, key), key)


def phones_from_hits(h: DataFrame, key: str = "company_id") -> DataFrame:
    """``company_phones`` from hits: map-side partial aggregation per (company,
    page, number) before anything is shuffled, so a company with very many
    pages sends each task's distinct numbers only."""
    per_page = (h.groupBy(key, "page_ord", "phone")
                .agg(F.min(F.struct("strategy", "pos", "confidence")).alias("f")))
    per_page = per_page.select(key, "page_ord", "phone", F.col("f.strategy").alias("strategy"),
                               F.col("f.pos").alias("pos"), F.col("f.confidence").alias("confidence"))
    g = per_page.groupBy(key, "phone").agg(
        F.min(F.struct("page_ord", "strategy", "pos", "confidence")).alias("first"),
        F.max(F.when((F.col("page_ord") > 1) & (F.col("confidence") == "high"), 1).otherwise(0))
        .alias("later_high"))
    conf = F.when(F.col("later_high") == 1, F.lit("high")).otherwise(F.col("first.confidence"))
    return g.select(key, "phone", conf.alias("confidence"),
                    F.col("first.page_ord").alias("page_ord"), F.col("first.strategy").alias("strategy"),
                    F.col("first.pos").alias("pos"))


def best_two(company_phones_df: DataFrame, key: str = "company_id") -> DataFrame:
    """Rank a company's numbers: confidence (high, medium, low), then mobile
    first, then discovery order; keep the top two and the full list."""
    ranked = company_phones_df.select(
        key, F.struct(conf_rank(F.col("confidence")).alias("c"),
                      F.when(classify_phone("phone") == "mobile", 0).otherwise(1).alias("m"),
                      "page_ord", "strategy", "pos", "phone", "confidence").alias("r"))
    g = ranked.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    p1, p2 = F.get(F.col("rs"), 0), F.get(F.col("rs"), 1)
    return g.select(
        F.col(key).alias("id"),
        F.coalesce(p1.phone, F.lit("")).alias("website_phone"),
        F.coalesce(classify_phone(p1.phone), F.lit("")).alias("website_phone_type"),
        F.coalesce(p2.phone, F.lit("")).alias("website_phone2"),
        F.when(p2.isNotNull(), classify_phone(p2.phone)).otherwise(F.lit("")).alias("website_phone2_type"),
        F.coalesce(p1.confidence, F.lit("")).alias("website_phone_source"),
        F.transform("rs", lambda r: F.concat(r.phone, F.lit(" ("), r.confidence, F.lit(")")))
        .alias("all_phones"))


def captured_site_pages(pages: DataFrame) -> DataFrame:
    """The pages a website check visits, from captured pages: each company's
    newest home page (page_ord 1) and the newest capture of the page that the
    home page's contact link leads to (page_ord 2)."""
    home = newest(pages.where((F.col("kind") == "site_home") & F.col("company_id").isNotNull()), "company_id")
    links = contact_links(home).where("contact_url is not null").select("company_id", F.col("contact_url").alias("url"))
    site = pages.where(F.col("kind").isin("site_home", "site_contact")).drop("company_id")
    contact = newest(site, "url").join(links, "url")
    cols = ["company_id", "page_ord", "url", "html", "body_text"]
    return (home.withColumn("page_ord", F.lit(1)).select(*cols)
            .unionByName(contact.withColumn("page_ord", F.lit(2)).select(*cols)))


def _results(candidates: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """One row per checkable candidate from its ranked numbers (empty fields
    when nothing was found)."""
    ids = checkable(candidates).select("id")
    empty = F.lit("")
    return (ids.join(best_two(phones, key), "id", "left")
            .select("id", *[F.coalesce(F.col(c), empty).alias(c) for c in
                            ["website_phone", "website_phone_type", "website_phone2",
                             "website_phone2_type", "website_phone_source"]],
                    F.coalesce(F.col("all_phones"), F.array().cast("array<string>")).alias("all_phones")))


def verify_websites(candidates: DataFrame, pages: DataFrame, page_key: str = "company_id") -> DataFrame:
    """One result row per checkable candidate (empty fields when nothing was
    found), like the website_phones schema. One lazy plan at every size: pages
    are reduced to hits where they are read, hits of other companies go by a
    join on the ids, and a left join from the ids adds the candidates
    without a hit."""
    ids = checkable(candidates).select(F.col("id").alias(page_key))
    hits = page_hits(pages, page_key).join(ids, page_key)                    # ids are unique
    return _results(candidates, phones_from_hits(hits, page_key), page_key)


def captured_visits(pages: DataFrame) -> DataFrame:
    """(company_id, page_ord, page_id) of the pages a website check visits: each
    company's newest home page (page_ord 1) and the newest capture of the page
    that its contact link leads to (page_ord 2). Only ids and addresses move."""
    home = pages.where((F.col("kind") == "site_home") & F.col("company_id").isNotNull())
    newest_home = home.groupBy("company_id").agg(F.max("page_id").alias("page_id"))
    links = contact_links(home, "page_id").where("contact_url is not null").select("page_id", F.col("contact_url").alias("url"))
    target = (pages.where(F.col("kind").isin("site_home", "site_contact")).groupBy("url").agg(F.max("page_id").alias("_to")))
    contact = newest_home.join(links, "page_id").join(target, "url").select("company_id", F.lit(2).alias("page_ord"), F.col("_to").alias("page_id"))
    return newest_home.select("company_id", F.lit(1).alias("page_ord"), "page_id").unionByName(contact)


def verify_captured(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """``verify_websites`` straight from captured pages: the pages to visit are
    chosen on narrow rows, every page is reduced to its hits where it is read,
    and hits meet visits by page id. No shuffle carries a page."""
    site = pages.where(F.col("kind").isin("site_home", "site_contact")).withColumn("page_ord", F.lit(1))
    hits = page_hits(site, "page_id").drop("page_ord")
    ids = checkable(candidates).select(F.col("id").alias("company_id"))
    visits = captured_visits(pages).join(ids, "company_id")
    return _results(candidates, phones_from_hits(hits.join(visits, "page_id")), "company_id")


# ------------------------------------------------------------------ V9


def apply_site_phones(leads: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Only results with a phone update a lead (a re-check never clears an
    old phone); the four phone columns and updated_at are written."""
    r = results.where(F.col("website_phone") != "").select(
        "id", *[F.col(c).alias(f"_r_{c}") for c in
                ["website_phone", "website_phone_type", "website_phone2", "website_phone2_type"]])
    j = leads.join(r, "id", "left")
    hit = F.col("_r_website_phone").isNotNull()
    out = j
    for c in ["website_phone", "website_phone_type", "website_phone2", "website_phone2_type"]:
        out = out.withColumn(c, F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)))
    out = out.withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp"))
                         .otherwise(F.col("updated_at")))
    return out.select(*leads.columns)
