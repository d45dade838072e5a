"""Field extraction from captured detail pages.

Each page is one row; the fields come from array higher-order functions over
its lines or anchors, so extraction is narrow (no shuffle) and runs in
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify_phone, clean_phone
from ..functions.html import anchors, attr, attributes, buttons, first_h1, inner_text, markup, named
from ..functions.patterns import (DIR_A_LABELS, DIR_B_ADDRESS_LABEL, DIR_B_BLOCKED_HOSTS,
                                  DIR_B_SKIP_LINES)
from ..functions.phones import BUTTON_PHONE_RE
from ..functions.text import blank, clean_line, let
from ..functions.tree import attrs_of, markup_of, opened, pieces, with_elements


def _rated(p) -> Column:
    """True for the start tag of a div of class F7nice."""
    classes = F.concat(F.lit(" "), F.regexp_replace(attr(attrs_of(p), "class"), r"\s", " "), F.lit(" "))
    return opened(p, "div") & p.contains("F7nice") & classes.contains(" F7nice ")


def with_rating(pages: DataFrame, markup: str, name: str = "rating") -> DataFrame:
    """Adds the text of the first span of aria-hidden="true" inside a div of class
    F7nice; '' where there is none."""
    df = pages.withColumn("_p", F.when(F.col(markup).contains("F7nice"), pieces(markup)))
    # what is before the first such div has no part in the rating
    at = F.array_position(F.transform("_p", lambda p: _rated(p)), True).cast("int")
    df = df.withColumn("_at", at).withColumn("_p", F.when(F.col("_at") > 0, F.concat(F.array(F.lit("")), F.slice("_p", F.col("_at"), F.size("_p")))))
    df = with_elements(df, "_e", "_p", own=lambda p: opened(p, "span") & p.contains("true") & (attr(attrs_of(p), "aria-hidden") == "true"),
                       mark=lambda p: F.when(_rated(p), "F").otherwise(""))
    inside = F.filter("_e", lambda e: e.path.rlike(">div:[0-9]+F[^>]*>"))
    # elements come in the order in which they end: the first to begin counts
    df = df.withColumn("_s", F.array_min(F.transform(inside, lambda e: F.struct(e.start.alias("start"), e.end.alias("end")))))
    return df.withColumn(name, inner_text(markup_of(F.col("_p"), F.col("_s")))).drop("_p", "_at", "_e", "_s")


def body_lines(text) -> Column:
    """Split on '\\n'; strip each line first, then drop characters outside
    0x20-0x7E (inner blanks next to removed characters can stay)."""
    return F.transform(F.split(blank(text), "\n"), lambda ln: clean_line(ln))


def _first(arr: Column) -> Column:
    return F.get(arr, 0)


def place_details(place_pages: DataFrame) -> DataFrame:
    """Map-place detail: name = h1; phone = first tel: link (cleaned), and
    only when the page has no tel: link at all, the first phone button whose
    label (aria-label, else text) holds a phone; website = authority link;
    address = address button label minus every 'Address: '; category and
    rating texts. Pages without a name are dropped."""
    a, b = F.col("_a"), F.col("_b")
    tel = F.filter(a, lambda x: x.href.startswith("tel:"))
    tel_phone = clean_phone(F.replace(_first(tel).href, F.lit("tel:"), F.lit("")))
    phone_btns = F.filter(b, lambda x: x["item"].contains("phone"))

    def label(x):
        return F.when(x.label != "", x.label).otherwise(inner_text(x.inner))
    btn_hits = F.filter(F.transform(phone_btns, lambda x: F.regexp_extract(label(x), BUTTON_PHONE_RE, 1)),
                        lambda m: m != "")
    btn_phone = clean_phone(F.coalesce(_first(btn_hits), F.lit("")))
    phone = F.when(F.size(tel) > 0, tel_phone).otherwise(btn_phone)

    auth = F.filter(a, lambda x: x["item"] == "authority")
    addr = F.filter(b, lambda x: x["item"] == "address")
    cat = F.filter(b, lambda x: x.action.contains("category"))
    pages = place_pages.select("page_id", "url", markup("html").alias("_h"))
    link = lambda x: let(attributes(x.attrs), lambda a: F.struct(
        named(a, "href").alias("href"), named(a, "data-item-id").alias("item")))
    button = lambda x: let(F.struct(attributes(x.attrs).alias("a"), x.inner.alias("inner")), lambda y: F.struct(
        named(y.a, "data-item-id").alias("item"), named(y.a, "aria-label").alias("label"), named(y.a, "jsaction").alias("action"),
        y.inner.alias("inner")))
    pages = pages.select("*", F.transform(anchors("_h"), link).alias("_a"), F.transform(buttons("_h"), button).alias("_b"))
    pages = with_rating(pages, "_h")
    out = pages.select(
        "page_id", "url",
        first_h1("_h").alias("name"),
        phone.alias("phone"),
        F.coalesce(_first(auth).href, F.lit("")).alias("website"),
        F.coalesce(F.replace(_first(addr).label, F.lit("Address: "), F.lit("")),
                   F.lit("")).alias("address"),
        F.coalesce(inner_text(_first(cat).inner), F.lit("")).alias("category"),
        "rating")
    out = out.withColumn("phone_type", F.when(F.col("phone") != "", classify_phone("phone"))
                         .otherwise(F.lit("")))
    return out.where(F.col("name") != "")


def label_fields(detail_pages: DataFrame) -> DataFrame:
    """Directory-A detail: for each fixed label line, the next line when it
    is non-empty and short enough; the last such pair wins. Rows are kept
    even when nothing is found."""
    # the lines are a column of their own, so every page is cleaned once
    df = detail_pages.select("page_id", *[c for c in ["url"] if c in detail_pages.columns],
                             body_lines("body_text").alias("_lines"))
    lines = F.col("_lines")
    pairs = F.arrays_zip(lines.alias("l"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("n"))
    df = df.withColumn("_pairs", pairs)

    def matches(label, limit):
        return lambda p: (p.l == label) & p.n.isNotNull() & (p.n != "") & (F.length(p.n) < limit)
    cols = []
    for label, field, limit in DIR_A_LABELS:
        hits = F.filter("_pairs", matches(label, limit))
        cols.append(F.coalesce(F.get(hits, F.size(hits) - 1).getField("n"), F.lit("")).alias(field))
    return df.select(*[c for c in ["page_id", "url"] if c in df.columns], *cols)


def company_profile(profile_pages: DataFrame) -> DataFrame:
    """Directory-B profile: over cleaned lines longer than one character,
    name = first line not a fixed skip line with 2 < len < 100; category =
    first later line that is not the name, shorter than 80 and not ending in
    'jobs'; address = among the four lines after the first 'Our Address', the
    first longer than 10; website = first http link naming none of the blocked
    hosts. Pages without a name are dropped."""
    lines = F.filter(body_lines("body_text"), lambda x: F.length(x) > 1)
    skip = F.array(*[F.lit(s) for s in DIR_B_SKIP_LINES])
    names = F.filter(lines, lambda x: ~F.array_contains(skip, x) & (F.length(x) > 2) & (F.length(x) < 100))
    name = F.coalesce(_first(names), F.lit(""))
    keep = [c for c in ["page_id", "url"] if c in profile_pages.columns]
    df = profile_pages.select(*keep, "html", lines.alias("_lines"), name.alias("name"))
    lines_c, name_c = F.col("_lines"), F.col("name")
    npos = F.array_position(lines_c, name_c)
    after = F.when(npos > 0, F.slice(lines_c, F.least(npos + 1, F.size(lines_c) + 1),
                                     F.greatest(F.size(lines_c) - npos, F.lit(1))))
    cats = F.filter(after, lambda x: (x != name_c) & (F.length(x) < 80) & ~x.endswith("jobs"))
    apos = F.array_position(lines_c, F.lit(DIR_B_ADDRESS_LABEL))
    near = F.when((apos > 0) & (apos < F.size(lines_c)), F.slice(lines_c, apos + 1, 4))
    addrs = F.filter(near, lambda x: F.length(x) > 10)
    hrefs = F.filter(F.transform(anchors(markup("html")), lambda x: attr(x.attrs, "href")), lambda h: h != "")

    def site_ok(h):
        ok = h.startswith("http")
        for b in DIR_B_BLOCKED_HOSTS:
            ok = ok & ~h.contains(b)
        return ok
    sites = F.filter(hrefs, site_ok)
    out = df.select(*keep, "name",
                    F.coalesce(_first(cats), F.lit("")).alias("category"),
                    F.coalesce(_first(addrs), F.lit("")).alias("address"),
                    F.coalesce(_first(sites), F.lit("")).alias("website"))
    return out.where(F.col("name") != "")


def page_titles(pages: DataFrame) -> DataFrame:
    """h1 text of each page as a company-name candidate (empty dropped)."""
    return (pages.select("page_id", first_h1(markup("html")).alias("name"))
            .where(F.col("name") != ""))


def lines_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) for every cleaned line of every text."""
    return docs.select(key, F.posexplode(body_lines(text)).alias("line_no", "line"))
