"""The element tree of captured markup, as column expressions.

``pieces`` cuts a page into tags in one linear pass; ``with_elements`` folds over
them with a stack of open elements and gives, for the elements a caller asks
for, the path of open elements, and the first and last piece they span. End
tags, void elements and the tags that HTML lets authors leave out (``</p>``,
``</li>``, ``</td>`` ...) follow the HTML standard's tree construction; formatting
elements that were cut off by a block are not opened again behind it.

The stack is a string, ``>html:1>body:2>div:7F>a:9``: name, number of the piece
that opened it, and the caller's mark. Opening appends, closing cuts at the last
such name unless an element in between shields it. Paths stop growing at
``DEEPEST`` characters (deeper elements count as part of the last one), so a
step has bounded cost and time is linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import ATTRS, END
from .text import blank, let

#: a tag and the text up to the next tag
PIECE_RE = rf"(?s)</?[a-zA-Z]{ATTRS}{END}[^<]*+(?:<(?!/?[a-zA-Z])[^<]*+)*+"
BEFORE_RE = r"(?s)^[^<]*+(?:<(?!/?[a-zA-Z])[^<]*+)*+"
DEEPEST = 4096
#: pieces folded before what was found is set aside
STRETCH = 512

# --- FIXED VALUES: element names of the HTML standard ---------------------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
CLOSES_P = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
            "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"]
SCOPE = ["applet", "caption", "marquee", "object", "table", "td", "template"]
SPECIAL = ["address", "applet", "article", "aside", "blockquote", "body", "button", "caption", "center", "colgroup",
           "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
           "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "iframe", "li", "main", "marquee",
           "menu", "nav", "noscript", "object", "ol", "p", "pre", "search", "section", "select", "summary", "table",
           "tbody", "td", "template", "textarea", "title", "tr", "ul"]
# --- end of FIXED VALUES ---------------------------------------------------

#: names that close each other count as one
SAME = {"th": "td", "dd": "dt", "thead": "tbody", "tfoot": "tbody"}
#: what shields an open element from being closed, by number
SHIELDS = [SCOPE, [*SCOPE, "button"], [*SCOPE, "ul", "ol"], ["table"], ["tr", "table"],
           [n for n in SPECIAL if n not in ("address", "div", "p", "li")],
           [n for n in SPECIAL if n not in ("address", "div", "p", "dt")], SPECIAL]
_SCOPE, _BUTTON, _LIST, _TABLE, _ROW, _ITEM, _TERM, _SPECIAL = range(8)
#: start tag -> the open element that it closes, and what shields that
OPENS = {"li": ("li", _ITEM), "dt": ("dt", _TERM), "td": ("td", _ROW), "tr": ("tr", _TABLE), "tbody": ("tbody", _TABLE),
         "option": ("option", _SPECIAL), "a": ("a", _SPECIAL), "button": ("button", _SCOPE)}
#: end tag -> what shields its element, where that is not the usual
CLOSES = {"p": _BUTTON, "li": _LIST, "td": _TABLE, "tr": _TABLE, "tbody": _TABLE, "table": _TABLE}
#: end tags that close nothing: what follows still belongs to the body
NEVER = ["body", "html"]


def pieces(markup) -> Column:
    """Text before the first tag, then every tag with the text after it."""
    return F.concat(F.array(F.regexp_extract(blank(markup), BEFORE_RE, 0)), F.regexp_extract_all(blank(markup), F.lit(PIECE_RE), 0))


def tag_name(piece: Column) -> Column:
    """Lower-case name of a piece's tag; '' before the first tag."""
    return F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][a-zA-Z0-9\-]*+)", 1))


def opened(piece: Column, name: str) -> Column:
    """True for a start tag of this name."""
    return piece.rlike(rf"(?i)^<{name}(?=[\s/>]|$)")


def attrs_of(piece: Column) -> Column:
    """The attribute text of a piece's tag."""
    return F.regexp_extract(piece, rf"(?s)^</?[a-zA-Z][^\s/>]*+({ATTRS}){END}", 1)


def _steps(parts: Column, own, parent, mark) -> Column:
    """Per piece what it does: its name, what it closes, whether it opens."""
    def one(p, i):
        def named(n):
            shut = p.startswith("</")
            closes, shield = F.when(n.isin(CLOSES_P), "p"), F.when(n.isin(CLOSES_P), _BUTTON)
            for k, (t, s) in OPENS.items():
                closes, shield = closes.when(n == k, t), shield.when(n == k, s)
            guard = F.when(n.isin(SPECIAL), _SCOPE).otherwise(_SPECIAL)
            for k, s in CLOSES.items():
                guard = F.when(n == k, s).otherwise(guard)
            wanted = F.when(own(p), F.lit("own")).when(parent(p), F.lit("parent")).otherwise("")
            return F.struct(i.alias("i"), n.alias("n"),
                            F.when(shut, F.when(n.isin(NEVER), "").otherwise(n)).otherwise(F.coalesce(closes, F.lit(""))).alias("t"),
                            F.when(shut, guard).otherwise(F.coalesce(shield, F.lit(_SCOPE))).alias("s"),
                            (~shut & ~n.isin(VOID) & (n != "")).alias("opens"),
                            F.when(shut, "").otherwise(wanted).alias("w"), F.when(shut, "").otherwise(mark(p)).alias("m"))
        name = tag_name(p)
        same = F.when(F.lit(False), "")
        return let(name, lambda n: let(_same(same, n), named))
    return F.transform(parts, one)


def _same(start: Column, n: Column) -> Column:
    for k, v in SAME.items():
        start = start.when(n == k, v)
    return start.otherwise(n)


def _shielded(above: Column, shield: Column) -> Column:
    out = F.lit(False)
    for number, names in enumerate(SHIELDS):
        out = F.when(shield == number, above.rlike(">(?:" + "|".join(names) + "):")).otherwise(out)
    return out


def _step(a, x):
    """One piece: cut the path where it closes an element, note what was
    wanted there, and open its own element. The expressions nest little, since
    every level of lambdas costs analysis time."""
    number = x.i.cast("string")

    def done(y):
        found = F.when(y.gone.contains("!"), F.concat(a.found, y.base, F.lit("|"), y.gone, F.lit("@"), number, F.lit("\n"))).otherwise(a.found)
        own = F.when(x.w == "own", F.concat(F.lit("!"), number)).otherwise("")
        entry = F.when(x.opens & (F.length(y.base) < DEEPEST), F.concat(F.lit(">"), x.n, F.lit(":"), number, x.m, own)).otherwise("")
        # an element with very many wanted children sets them aside: the path stays short
        head = F.regexp_extract(y.base, "^(.*>[^>!]*)", 1)
        aside = F.concat(a.aside, F.regexp_extract(head, ":([0-9]+)[^:>]*$", 1), F.substring(y.base, F.length(head) + 1, F.length(y.base)),
                         F.lit("!"), number, F.lit("\n"))
        return F.when(x.w != "parent", F.struct(F.concat(y.base, entry).alias("path"), found.alias("found"), a.aside.alias("aside"))).when(
            F.length(y.base) < DEEPEST, F.struct(F.concat(y.base, F.lit("!"), number, entry).alias("path"), found.alias("found"),
                                                 a.aside.alias("aside"))).otherwise(
            F.struct(F.concat(head, F.lit("!"), entry).alias("path"), found.alias("found"), aside.alias("aside")))

    def close(above):
        kept = F.length(a.path) - F.length(above) - F.length(x.t) - 2
        cuts = (x.t != "") & (F.length(above) < F.length(a.path)) & ~_shielded(F.concat(F.lit(""), above), x.s)
        return let(F.when(cuts, F.struct(F.substring(a.path, F.lit(1), kept).alias("base"), F.substring(a.path, kept + 1, F.length(a.path)).alias("gone")))
                   .otherwise(F.struct(a.path.alias("base"), F.lit("").alias("gone"))), done)

    return let(F.call_function("substring_index", a.path, F.concat(F.lit(">"), x.t, F.lit(":")), F.lit(-1)), close)


def _numbers(marks):
    return F.transform(F.regexp_extract_all(marks, F.lit("!([0-9]+)"), 1), lambda n: n.cast("int"))


def _lines(array):
    return F.filter(F.split(F.array_join(array, ""), "\n"), lambda s: s != "")


def _told(record, aside):
    """The elements of one record that are wanted."""
    base, rest = F.substring_index(record, "|", 1), F.substring_index(record, "|", -1)
    entries = F.regexp_extract_all(F.substring_index(rest, "@", 1), F.lit(">[^>]+"), 0)
    end = F.substring_index(rest, "@", -1).cast("int")
    return let(entries, lambda es: F.transform(es, lambda e, j: F.struct(
        F.concat(base, F.array_join(F.slice(es, F.lit(1), j + 1), "")).alias("path"),
        F.regexp_extract(e, ":([0-9]+)", 1).cast("int").alias("start"), end.alias("end"),
        F.concat(F.flatten(F.transform(F.filter(aside, lambda m: m.startswith(F.concat(F.regexp_extract(e, ":([0-9]+)", 1), F.lit("!")))), _numbers)),
                 _numbers(e)).alias("wanted"))))


def _folded(steps: Column) -> Column:
    """struct<records, aside> of the fold over all steps."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int"))
    nothing = F.array().cast("array<string>")
    start = F.struct(F.lit(">#:0").alias("path"), nothing.alias("found"), nothing.alias("aside"))

    def stretch(a, k):
        some = F.slice(steps, k * STRETCH + 1, F.lit(STRETCH))
        begin = F.struct(a.path.alias("path"), F.lit("").alias("found"), F.lit("").alias("aside"))
        return F.aggregate(some, begin, _step, lambda r: F.struct(
            r.path.alias("path"), F.concat(a.found, F.array(r.found)).alias("found"), F.concat(a["aside"], F.array(r["aside"])).alias("aside")))

    def finish(r):
        last = F.when(r.path.contains("!"), F.array(F.concat(F.lit("|"), r.path, F.lit("@"), F.size(steps).cast("string"), F.lit("\n")))).otherwise(nothing)
        return F.struct(_lines(F.concat(r.found, last)).alias("records"), _lines(r["aside"]).alias("aside"))
    return F.aggregate(blocks, start, stretch, finish)


def with_elements(df: DataFrame, name: str, parts: str, own=None, parent=None, mark=None) -> DataFrame:
    """Adds ``name``, array<struct<path, start, end, wanted>> in the order in which
    elements end: the elements for whose start tag ``own`` holds, and the parents
    of those for which ``parent`` holds. ``wanted`` are the numbers of the start
    tags asked for; the element is ``parts[start : end]``. ``mark`` gives a letter
    that the path shows behind an element's number (``>div:3F``). NULL where the
    column ``parts`` is NULL. Each step is a column of its own: one expression
    of all would take the analyzer many more rounds."""
    false, none = (lambda p: F.lit(False)), (lambda p: F.lit(""))
    df = df.withColumn(f"{name}_steps", _steps(F.col(parts), own or false, parent or false, mark or none))
    df = df.withColumn(f"{name}_fold", F.when(F.col(f"{name}_steps").isNotNull(), _folded(F.col(f"{name}_steps"))))
    told = F.flatten(F.transform(F.col(f"{name}_fold.records"), lambda record: _told(record, F.col(f"{name}_fold.aside"))))
    return df.withColumn(name, F.filter(told, lambda e: F.size(e.wanted) > 0)).drop(f"{name}_steps", f"{name}_fold")


def markup_of(parts: Column, element) -> Column:
    """The markup of an element: its start tag and all up to its end."""
    return F.array_join(F.slice(parts, element.start + 1, element.end - element.start), "")
