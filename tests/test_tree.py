"""The element tree against a list-based stack, and pages made to break patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import tree as T
from leadloom.operators import extract as EX
from leadloom.operators import links as LK
from leadloom.operators import verify as VF

TAG = re.compile(r"</?[a-zA-Z][^>]*>")


def brute(markup):
    """(parent number, end) by start tag, from a plain list of open elements."""
    stack, out = [("#", 0)], {}

    def close(names, shield):
        for j in range(len(stack) - 1, 0, -1):
            if stack[j][0] in names:
                end(j)
                return
            if stack[j][0] in shield:
                return

    def end(j):
        for _, at in stack[j:]:
            out[at] = (out[at][0], i)
        del stack[j:]

    tags = [""] + TAG.findall(markup)
    for i, tag in enumerate(tags):
        if not i:
            continue
        n = re.match(r"</?([a-zA-Z0-9]+)", tag).group(1).lower()
        n = T.SAME.get(n, n)
        if tag.startswith("</"):
            if n in T.NEVER:
                continue
            shield = T.SHIELDS[T.CLOSES[n]] if n in T.CLOSES else T.SHIELDS[T._SCOPE] if n in T.SPECIAL else T.SPECIAL
            close([n], shield)
            continue
        if n in T.OPENS:
            close([T.OPENS[n][0]], T.SHIELDS[T.OPENS[n][1]])
        elif n in T.CLOSES_P:
            close(["p"], T.SHIELDS[T._BUTTON])
        out[i] = (stack[-1][1], i + 1)
        if n not in T.VOID:
            stack.append((n, i))
    i = len(tags)
    end(1)
    return out, len(tags)


def soup(r, n):
    names = ["div", "p", "span", "b", "a", "li", "ul", "td", "tr", "table", "br", "img", "dt", "dd", "dl", "section", "h2", "button", "th", "body", "tbody"]
    return "start" + "".join(r.choice(["<{}>", "<{} x=1>", "</{}>", "<{}>", "</{}>"]).format(r.choice(names)) + r.choice(["", "t", " < 3 "]) for _ in range(n))


def test_tree_equals_a_stack(spark):
    r = random.Random(6)
    pages = [soup(r, r.choice([0, 1, 5, 30, 80])) for _ in range(120)] + [soup(r, 1500)]       # the last: several stretches
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").repartition(4)
    opens = lambda p: p.rlike("^<[a-zA-Z]")
    df = T.with_elements(df.withColumn("p", T.pieces("html")), "own", "p", own=opens)
    got = T.with_elements(df, "up", "p", parent=opens).select("id", F.size("p").alias("n"), "own", "up").collect()
    for row in got:
        want, n = brute(pages[row["id"]])
        assert row["n"] == n
        void = {i for i in want if want[i][1] == i + 1 and i not in {e["start"] for e in row["own"]}}
        assert {e["start"]: e["end"] for e in row["own"]} == {i: e for i, (_, e) in want.items() if i not in void}
        assert {w: e["start"] for e in row["up"] for w in e["wanted"]} == {i: p for i, (p, _) in want.items()}


def test_paths_and_marks(spark):
    df = spark.createDataFrame([("<div role=feed><div class='a>b'><p>x<div><span>y</span></div></div></div>z<span>q</span>",)], "html string")
    df = T.with_elements(df.withColumn("p", T.pieces("html")), "e", "p", own=lambda p: T.opened(p, "span"),
                         mark=lambda p: F.when(p.contains("feed"), "F").otherwise(""))
    rows = df.select(F.explode("e").alias("e")).select("e.*").collect()
    # the inner div closes the open paragraph
    assert [(re.sub("[:0-9!]", "", r["path"]), r["start"]) for r in rows] == [(">#>divF>div>div>span", 5), (">#>span", 10)]


def phones(spark, html):
    p = spark.createDataFrame([(1, 1, "u", html, "")], "company_id long, page_ord int, url string, html string, body_text string")
    return sorted(r["phone"] for r in VF.company_phones(p).collect())


@pytest.mark.parametrize("html, want", [
    ('<p><span>Tel <a href="tel:0312345678">x</a></span> <span>Fax 03-22345678</span></p>', ["0312345678"]),
    ('<p>Fax <span><a href="tel:0312345678">x</a></span></p>', ["0312345678"]),        # the parent is the span
    ('<p><b>Fax</b> <a href="tel:0312345678">x</a></p>', []),
    ('<ul><li>Fax<li><a href="tel:0312345678">x</a></ul>', ["0312345678"]),
    ('<table><tr><td>Fax<td><a href="tel:0312345678">x</a></table>', ["0312345678"]),
    ('<table><tr><td>Fax <a href="tel:0312345678">x</a><td>y</table>', []),
    ('<p>Fax<p><a href="tel:0312345678">x</a>', ["0312345678"]),
    ('<div>Fax<br><img src=x><a href="tel:0312345678">x</a></div>', []),
    ('fax <a href="tel:0312345678">x</a>', []),                                        # the body is the parent
    ('<div></span></p><a title="5\' > 3" href=tel:0312345678>x</a></div>Fax', ["0312345678"]),
    ('<a href="tel:0312345678">one<a href="tel:0387654321">two', ["0312345678", "0387654321"]),
    ('<!-- <a href="tel:0312345678">x</a>', []),
    ('<script>"<a href=tel:0312345678>"', []),
])
def test_the_parent_of_a_tel_link(spark, html, want):
    assert phones(spark, html) == want


def test_attributes(spark):
    cases = [("x=1 href='a&amp;b'", "a&b"), ("HREF = \"q>r\"", "q>r"), ("data-href=no href", ""), ("title=\"href=no\" href=yes", "yes"),
             ("href=first href=second", "first"), ("href=\"open", "open"), ("href=''", ""), ("a=5' href=b'c", "b'c"), (None, ""),
             (" ".join(f"a{i}='{i}'" for i in range(20_000)) + " href=end", "end")]
    df = spark.createDataFrame(cases, "attrs string, want string").select("want", H.attr("attrs", "href").alias("got"))
    assert [r["got"] for r in df.collect()] == [w for _, w in cases]


BREAKERS = {
    "attributes": lambda n: "<a " + " ".join(f"a{i}=\"{i}\"" for i in range(n)) + " href='tel:0312345678'>x</a>",
    "open links": lambda n: "<p>" + "".join(f"<a href='tel:03{i:08}'>y" for i in range(n)),
    "open comments": lambda n: "<a href=tel:0312345678>x</a>" + "<!-- " * n,
    "open quotes": lambda n: "<a href=tel:0312345678>x</a>" + "<a href='" * n,
    "open tags": lambda n: "<a href=tel:0312345678>x</a>" + "<p " * n,
    "open headings": lambda n: "<h1>tel:" * n,
    "end tags": lambda n: "<a href=tel:0312345678>x</a>" + "</div>" * n,
    "deep elements": lambda n: "<div>" * n + "<a href=tel:0312345678>x</a>",
    "open scripts": lambda n: "<a href=tel:0312345678>x</a>" + "<script>" * n,
}


def test_broken_pages_take_linear_time(spark):
    def seconds(n):
        rows = [(i, 1, "u", "u", page(n), None) for i, page in enumerate(BREAKERS.values())]
        df = spark.createDataFrame(rows, "company_id long, page_ord int, url string, page_id string, html string, body_text string").coalesce(1)
        t = time.perf_counter()
        hits = VF.page_hits(df).groupBy("company_id").count().collect()
        EX.place_details(df).collect()
        LK.contact_links(df).collect()
        return time.perf_counter() - t, {r["company_id"]: r["count"] for r in hits}
    small, large = seconds(5_000), seconds(50_000)
    kinds = list(BREAKERS)
    assert large[1][kinds.index("open links")] == 50_000 and large[1][kinds.index("attributes")] == 1 and large[1][kinds.index("deep elements")] == 1
    assert large[0] < 20 * max(small[0], 1.0)


def test_feed_and_rating_by_the_tree(spark):
    feed = ('<div role="feed"><div><div><a href="/maps/place/1">a</a><p><a href="/maps/place/no">b</a></p><a href="/maps/place/2">c</a></div></div>'
            '<div><span><a href="/maps/place/no2">x</a></span></div></div><div><div><a href="/maps/place/no3">x</a></div></div>')
    p = spark.createDataFrame([(1, 1, feed), (1, 2, "<p>none</p>"), (1, 3, None)], "seed_no long, page_no long, html string")
    assert sorted((r["href"], r["pos"]) for r in LK.place_links(p).collect()) == [("/maps/place/1", 0), ("/maps/place/2", 1)]
    page = '<h1>N</h1><span aria-hidden="true">no</span><div class="a F7nice b"><i><span aria-hidden=true>4.<b>5</b></span></i><span aria-hidden=true>6</span></div>'
    d = spark.createDataFrame([(1, "u", page), (2, "u", "<h1>M</h1><div class=F7nicer><span aria-hidden=true>1</span></div>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["rating"] for r in EX.place_details(d).collect()} == {1: "4.5", 2: ""}


def test_windows_of_many_phones(spark):
    r = random.Random(2)
    text = "".join(r.choice(["call 03-1234 5678", "0123456789", " fax ", "x" * 30, "\n", "+60 3 1234567"]) for _ in range(400))
    rx = re.compile(r"\+?6?0[1-9][\d\s\-.]{7,13}")
    want = [(m.group(), text[max(0, m.start() - 60):m.end() + 20]) for m in rx.finditer(text)]
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(x["raw"], x["context"]) for x in VF.text_phones(d).orderBy("pos").collect()] == want
