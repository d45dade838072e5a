"""HTML column builders over captured pages (regex-based; no DOM).

A captured page is one row; these builders turn its HTML into arrays of
anchors, headings and text blocks with built-in functions, so the work stays
in the JVM and scales with the number of pages. Operators first make the
``markup`` column (scripts, styles and comments gone) and use it for all else.

Every pattern reads a page once: what a page leaves open (a comment, a tag, a
quoted value, a link) ends with the page, so that nothing is tried again from
each place, and repetitions are possessive, so that none is a stack frame.
``tree`` has the element tree. Difference from a rendered DOM (documented): hidden
elements count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, py_strip

# Attribute text of a tag: quotes count behind '=', and quoted values may hold '>'.
ATTRS = r"""[^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+[^>=]*+)*+"""
# A tag ends at '>' or with the page.
END = r"(?:>|\z)"


def _element_re(name: str, ends: str) -> str:
    """Attributes and content of an element that ends at the next start or end
    tag of ``ends``."""
    return rf"(?is)<{name}(?=[\s/>])({ATTRS}){END}([^<]*+(?:<(?!/?{ends}[\s/>])[^<]*+)*+)"


ANCHOR_RE = _element_re("a", "a")
BUTTON_RE = _element_re("button", "button")
H1_RE = _element_re("h1", "h[1-6]")
UNSEEN_RE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
TAG_RE = rf"(?s)</?[a-zA-Z!]{ATTRS}{END}"
# Boundaries of block elements and line breaks: they separate text.
BLOCK_NAMES = ("p|div|li|td|th|tr|ul|ol|dl|dt|dd|table|section|article|header|footer|nav|main|aside|form|"
               "blockquote|pre|address|figure|hr|h[1-6]|body|html|br")
BLOCK_RE = rf"(?i:</?(?:{BLOCK_NAMES})(?:[\s/][^>]*+)?+(?:>|\z))"
NUMERIC_RE = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

# FIXED VALUES: named entities, decoded in this order (&amp; last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def markup(html) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(blank(html), UNSEEN_RE, "")


def _sql(c, function: str) -> Column:
    """A function given as SQL text (``x -> ...``) applied to a column. Text is
    one call to the session where the same expression built by functions is
    a hundred."""
    return F.get(F.call_function("transform", F.array(c), F.expr(function)), F.lit(0))


def _decode_sql() -> str:
    """Numeric entities but those of '&' first, then the named ones, '&' last: an
    escaped entity stays text."""
    digits = "regexp_extract(e, r'&#[xX]?([0-9a-fA-F]+);', 1)"
    code = f"CAST(IF(e RLIKE r'^&#[xX]', conv({digits}, 16, 10), {digits}) AS BIGINT)"
    point = f"transform(array({code}), n -> IF(n BETWEEN 1 AND {0xD7FF} OR n BETWEEN {0xE000} AND {0x10FFFF}, n, {0xFFFD}))[0]"
    found = f"transform(array_distinct(regexp_extract_all(s, r'{NUMERIC_RE}', 0)), e -> struct(e AS e, decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32') AS c))"
    out = f"IF(contains(s, '&#'), aggregate(filter({found}, x -> x.c <> '&'), s, (acc, x) -> replace(acc, x.e, x.c)), s)"
    for ent, ch in ENTITIES[:-1]:
        out = f"replace({out}, '{ent}', " + (f'"{ch}"' if ch == "'" else f"'{ch}'") + ")"
    return f"s -> IF(contains(s, '&'), regexp_replace({out}, r'&(?:amp|#0*38|#[xX]0*26);', '&'), s)"


_DECODE = _decode_sql()


def decode_entities(c) -> Column:
    """Numeric and the basic named entities as characters."""
    return _sql(c, _DECODE)


def strip_tags(c) -> Column:
    """Text of a piece of ``markup``: neighbouring block boundaries become one
    line break, other tags go, entities are decoded."""
    s = F.regexp_replace(blank(c), rf"(?:{BLOCK_RE}\s*+)++", "\n")
    return decode_entities(F.regexp_replace(s, TAG_RE, ""))


def inner_text(c) -> Column:
    """Stripped visible text (like an element's inner text, trimmed)."""
    return py_strip(strip_tags(c))


def elements(c, pattern: str) -> Column:
    """array<struct<attrs, inner>> of the matches of an element pattern: whole
    matches are found once, then each small match is taken apart."""
    return F.transform(F.regexp_extract_all(blank(c), F.lit(pattern), 0), lambda m: F.struct(
        F.regexp_extract(m, pattern, 1).alias("attrs"), F.regexp_extract(m, pattern, 2).alias("inner")))


def anchors(c) -> Column:
    """Every <a> element in document order; a link that is still open ends where
    the next begins."""
    return elements(c, ANCHOR_RE)


def buttons(c) -> Column:
    return elements(c, BUTTON_RE)


# One attribute: its name, and its value where it has one.
ATTR_RE = r"""(?s)[^\s=/>"']++(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>]*+))?+"""


_ATTRIBUTES = """a -> struct(lower(regexp_extract(a, r'^[^\\s=]+', 0)) AS name, transform(array(regexp_extract(a, r'(?s)^[^=]*+=\\s*+(.*)$', 1)),
  v -> CASE WHEN left(v, 1) NOT IN ('"', "'") THEN v ELSE substring(v, 2, length(v) - IF(length(v) > 1 AND left(v, 1) = right(v, 1), 2, 1)) END)[0] AS value)"""


def attributes(attrs) -> Column:
    """array<struct<name, value>> of a tag's attributes in order: names in lower
    case, values double-quoted, single-quoted or bare, without their quotes."""
    return F.call_function("transform", F.regexp_extract_all(blank(attrs), F.lit(ATTR_RE), 0), F.expr(_ATTRIBUTES))


def named(found: Column, name: str) -> Column:
    """Value of an attribute among ``attributes``, entities decoded; '' if absent.
    The first of equal names counts."""
    return decode_entities(F.coalesce(F.get(F.filter(found, lambda x: x["name"] == name), 0)["value"], F.lit("")))


def attr(attrs, name: str) -> Column:
    """``named`` on the attribute text of a tag."""
    return let(blank(attrs), lambda a: F.when(a.rlike(rf"(?i){name}"), named(attributes(a), name)).otherwise(""))


def first_h1(c) -> Column:
    return inner_text(F.regexp_extract(blank(c), H1_RE, 2))


# scheme://authority of an absolute URL
ORIGIN_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"


def _without_dots(url: Column) -> Column:
    """Dot segments of the path resolved ('.' dropped, '..' takes the segment
    before it)."""
    empty = F.array().cast("array<string>")

    def joined(x):                       # origin, path, rest
        kept = F.aggregate(F.split(x.path, "/"), empty, lambda acc, s: F.when(s == ".", acc)
                           .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
                           .otherwise(F.concat(acc, F.array(s))))
        end = F.when(x.path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(x.org, F.array_join(kept, "/"), end, x.tail)

    def resolved(u):
        if_dots = let(F.struct(F.regexp_extract(u, ORIGIN_RE, 1).alias("org"),
                               F.regexp_extract(u, ORIGIN_RE + r"([^?#]*)", 2).alias("path"),
                               F.regexp_extract(u, r"([?#].*)$", 1).alias("tail")), joined)
        return F.when(u.rlike(r"^[^?#]*/\.{1,2}(?:[/?#]|$)"), if_dots).otherwise(u)

    return let(url, resolved)


def resolve_url(base, href) -> Column:
    """Resolve ``href`` against ``base`` (absolute, scheme-relative,
    root-relative, query, fragment and path-relative forms)."""
    def resolved(x):                     # base without fragment, and without query
        h, directory = x.h, F.regexp_extract(x.path, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
        return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
                .when(h == "", x.b)
                .when(h.startswith("//"), F.concat(F.regexp_extract(x.b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1), F.lit(":"), h))
                .when(h.startswith("?"), F.concat(x.path, h))
                .when(h.startswith("#"), F.concat(x.page, h))
                .when(h.startswith("/"), _without_dots(F.concat(F.regexp_extract(x.b, ORIGIN_RE, 1), h)))
                .otherwise(_without_dots(F.concat(F.regexp_replace(directory, "/$", ""), F.lit("/"), h))))

    b = blank(base)
    return let(F.struct(b.alias("b"), blank(href).alias("h"), F.regexp_replace(b, "#.*$", "").alias("page"),
                        F.regexp_replace(b, r"[?#].*$", "").alias("path")), resolved)
