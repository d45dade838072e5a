"""Link, detail-field and website-phone extraction on hand-written pages."""

from leadloom.operators import extract as EX
from leadloom.operators import links as LK
from leadloom.operators import verify as VF


def pages(spark, data, cols="page_id long, seed_no long, page_no long, html string"):
    return spark.createDataFrame(data, cols)


def feed(*links):
    return '<div role="feed">' + "".join(f"<div><div>{x}</div></div>" for x in links) + "</div>"


def test_place_links_first_seen_and_limit(spark):
    p = pages(spark, [
        (1, 1, 1, feed('<a href="/maps/place/A">A</a>', "<a href='/maps/place/B'>B</a>", '<a href="/x">x</a>')),
        (2, 2, 1, feed('<a href="/maps/place/B">B</a>', '<a href=/maps/place/C>C</a>')),
    ])
    assert sorted(r["href"] for r in LK.place_links(p).collect()) == ["/maps/place/A", "/maps/place/B", "/maps/place/C"]
    assert [r["href"] for r in LK.place_links(p, 2).collect()] == ["/maps/place/A", "/maps/place/B"]


def test_place_links_only_from_the_feed(spark):
    inside = '<div><div><a href="/maps/place/in">x</a><span>y</span></div></div>'
    p = pages(spark, [(1, 1, 1, '<a href="/maps/place/nav">n</a><div><div><a href="/maps/place/before">b</a></div></div>'
                                "<div class='m' role=feed>" + '<a href="/maps/place/child">c</a>' + inside
                                + '<div><div><div><a href="/maps/place/deep">d</a></div></div></div>' + inside.replace("/in", "/in2")
                                + '</div><div><div><a href="/maps/place/after">a</a></div></div>')])
    assert sorted(r["href"] for r in LK.place_links(p).collect()) == ["/maps/place/in", "/maps/place/in2"]


def test_attribute_forms_and_entities(spark):
    home = spark.createDataFrame([
        (1, "http://a.my/x/y.html", "<a class=b href='/contact?a=1&amp;b=2'>Us</a>"),
        (2, "http://b.my/x/y/", "<a href=../contact.html>Us</a>"),
        (3, "http://c.my", "<!-- <a href='/contact-old'>Contact</a> --><script>'<a href=\"/contact-js\">Contact</a>'</script>"
                           "<a title=\"href='/contact-no'>\" data-href='/contact-data' HREF=\"/contact&#45;us\"><b>Contact</b></a>"),
        (4, "http://d.my/p?q#f", "<a href='//e.my/contact'>x</a>"),
        (5, "http://f.my/a/b/c", "<a href='./../contact/./'>x</a>"),
    ], "company_id long, url string, html string")
    got = {r["company_id"]: r["contact_url"] for r in LK.contact_links(home).collect()}
    assert got == {1: "http://a.my/contact?a=1&b=2", 2: "http://b.my/x/contact.html", 3: "http://c.my/contact-us",
                   4: "http://e.my/contact", 5: "http://f.my/a/contact/"}


def test_text_of_markup(spark):
    from pyspark.sql import functions as F
    from leadloom.functions import html as H
    cases = {"Foo<br>Bar": "Foo\nBar", "<td>Tel 03-1234567</td><td>8899 units</td>": "Tel 03-1234567\n8899 units",
             "a&nbsp;b &#233;&#xE9;&#x1F600; &amp;lt; &#38;gt; &lt;": "a\u00a0b éé\U0001F600 &lt; &gt; <", "<b>B</b>old <i>x</i>": "Bold x",
             "<p>a<!-- <p>no --></p><style>.x{}</style><script>no()</script>": "a", "1 < 2 &#0; &#99999999;": "1 < 2 \ufffd &#99999999;",
             "<span title='a > b'>x</span>": "x", None: "", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, want string")
    for r in df.select("html", "want", F.btrim(H.strip_tags(H.markup("html")), F.lit("\n")).alias("got")).collect():
        assert r["got"] == r["want"], r["html"]


def test_tel_links_that_wrap_blocks_and_fax_by_block(spark):
    p = site(spark, [
        (1, 1, "u", '<div>x</div><a href="tel:0312345678"><div>Call</div></a>', ""),
        (2, 1, "u", '<p>Fax <a href="tel:0312345678"><div>here</div></a></p><p><a href=tel:0387654321>y</a></p>', ""),
        (3, 1, "u", '<!-- <a href="tel:0312345678">c</a> --><a href=\'tel:0399998888\'>c</a>', ""),
        (4, 1, "u", "<td>Tel 03-1234 5678</td><td>Level 8</td>", None),
    ])
    got = sorted((r["company_id"], r["phone"], r["confidence"]) for r in VF.company_phones(p).collect())
    assert got == [(1, "0312345678", "high"), (2, "0387654321", "high"), (3, "0399998888", "high"), (4, "0312345678", "medium")]


def test_directory_links(spark):
    p = pages(spark, [(1, 1, 1,
        '<a href="/companies/a?x=1"> Café A </a><a href="/companies/b">Write a review</a>'
        '<a href="/companies?page=2">Firm</a><a href="/companies/c">X</a>'
        '<a href="https://my.jobstreet.com/companies/a">Other name</a>')])
    got = [(r["name"], r["url"]) for r in LK.directory_a_links(p).collect()]
    assert got == [("Caf A", "https://my.jobstreet.com/companies/a")]
    b = LK.directory_b_links(pages(spark, [(1, 1, 1, '<a href="/companies/z">z</a>'
                                                     '<a href="https://my.hiredly.com/companies/z">z</a>'
                                                     '<a href="/companies?i=1">i</a>')]))
    assert [r["url"] for r in b.collect()] == ["https://my.hiredly.com/companies/z"]


def test_contact_links(spark):
    home = spark.createDataFrame([
        (1, "http://a.example.com/x/index.html",
         '<a href="https://facebook.com/contact">fb</a><a href="/about-us">About</a>'
         '<a href="contact.html">Write to us</a><a href="/hubungi">Hubungi</a>'),
        (2, "http://b.example.com", '<a href="mailto:x@y">Contact</a><a href="/reach">Reach us</a>'),
        (3, "http://c.example.com", '<a href="/about-us">About</a>'),
        (4, "http://d.example.com", '<a>Contact</a><a href="/contact">Contact</a>'),
    ], "company_id long, url string, html string")
    got = {r["company_id"]: r["contact_url"] for r in LK.contact_links(home).collect()}
    assert got[1] == "http://a.example.com/x/contact.html"
    assert 2 not in got and 3 not in got          # no candidate accepted
    assert got[4] is None                         # first accepted link has no href


def test_label_fields_last_wins(spark):
    body = "Website\n http://a.my \nIndustry\n\nIndustry\nIT\nCompany size\n" + "x" * 150 + \
           "\nPrimary location\nKL — 1\nIndustry\nRetail\nWebsite"
    d = spark.createDataFrame([(1, body)], "page_id long, body_text string")
    r = EX.label_fields(d).first()
    assert (r["website"], r["category"], r["company_size"], r["address"]) == ("http://a.my", "Retail", "", "KL  1")


def test_label_fields_grow_with_the_lines(spark):
    """Ten times the lines, no more than thirty times the time (it was a
    hundred when every line cleaned the page again)."""
    import time
    def page(n):
        return spark.createDataFrame([(i, "Industry\nIT\n" + "\n".join(f"line {k}  " for k in range(n))) for i in range(4)],
                                     "page_id long, body_text string").coalesce(1)
    def seconds(n):
        df = EX.label_fields(page(n))
        assert {r["category"] for r in df.collect()} == {"IT"}
        t = time.perf_counter()
        df.collect()
        return time.perf_counter() - t
    seconds(200)
    assert seconds(4000) < 30 * max(seconds(400), 0.05)


def test_company_profile(spark):
    body = "Companies\nLog In\nx\nAb\nAcme Sdn Bhd\n12 jobs\nSoftware\nOur Address\nKL\n \nLot 1, Jalan Ampang\nEnglish"
    html = '<a href="https://facebook.com/a">f</a><a href="/r">r</a><a href="https://acme.my">w</a>'
    d = spark.createDataFrame([(1, body, html), (2, "Companies\nLog In", "")],
                              "page_id long, body_text string, html string")
    out = EX.company_profile(d).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["name"], r["category"], r["address"], r["website"]) == \
        ("Acme Sdn Bhd", "Software", "Lot 1, Jalan Ampang", "https://acme.my")


def test_place_details(spark):
    html = ('<h1> Alpha &amp; Co </h1><button data-item-id="phone:tel:x" aria-label=""><div>012 3456789</div>'
            '</button><a data-item-id="authority" href="http://alpha.my">w</a>'
            '<button data-item-id="address" aria-label="Address: No 1, Bangsar">a</button>'
            '<button jsaction="pane.category">Cafe</button><div class="F7nice"><span aria-hidden="true">4.5</span></div>')
    d = spark.createDataFrame([(1, "u", html), (2, "u", "<p>no name</p>"),
                               (3, "u", '<h1>B</h1><a href="tel:+60 3-1234 5678">t</a>'
                                        '<button data-item-id="phone" aria-label="Phone: 012-3456789">p</button>')],
                              "page_id long, url string, html string")
    out = {r["page_id"]: r for r in EX.place_details(d).collect()}
    assert sorted(out) == [1, 3]
    a = out[1]
    assert (a["name"], a["phone"], a["phone_type"], a["website"], a["address"], a["category"], a["rating"]) == \
        ("Alpha & Co", "0123456789", "mobile", "http://alpha.my", "No 1, Bangsar", "Cafe", "4.5")
    assert out[3]["phone"] == "+60312345678" and out[3]["phone_type"] == "landline"


def site(spark, data):
    return spark.createDataFrame(data, "company_id long, page_ord int, url string, html string, body_text string")


def test_fax_lookahead_and_confidence(spark):
    p = site(spark, [(1, 1, "http://a", "<p>x</p>", "Tel: 03-1234 5678 Fax: 03-2234 5678"),
                     (2, 1, "http://b", "<p>x</p>", "Our office 03-1234 5678 is open daily from nine to five"),
                     (3, 1, "http://c", "<p>x</p>", "Order 03-1234 5678 widgets")])
    got = {(r["company_id"], r["phone"]): r["confidence"] for r in VF.company_phones(p).collect()}
    # The fax word 20 characters ahead also drops the telephone number
    assert got == {(2, "0312345678"): "medium", (3, "0312345678"): "low"}


def test_home_contact_fold_and_best_two(spark):
    p = site(spark, [
        (1, 1, "http://a", '<p>Fax <a href="tel:0398765432">f</a></p><p><a href="tel:03%2012345678">t</a></p>'
                           '<a href="https://wa.me/60123456789">w</a>', "Call 03-5555 1234 now"),
        (1, 2, "http://a/contact", '<p><a href="tel:0355551234">c</a></p>', "Hubungi 017-222 3333"),
    ])
    cp = {r["phone"]: (r["confidence"], r["page_ord"]) for r in VF.company_phones(p).collect()}
    assert cp == {"0312345678": ("high", 1), "0123456789": ("high", 1),
                  "0355551234": ("high", 1),   # medium on home, high on contact -> high
                  "0172223333": ("medium", 2)}
    b = VF.best_two(VF.company_phones(p)).first()
    assert (b["website_phone"], b["website_phone_type"], b["website_phone2"], b["website_phone_source"]) == \
        ("0123456789", "mobile", "0312345678", "high")
    assert b["all_phones"] == ["0123456789 (high)", "0312345678 (high)", "0355551234 (high)",
                               "0172223333 (medium)"]


def test_verify_and_apply(spark):
    from leadloom.schemas import conform_leads
    import datetime as dt
    leads = conform_leads(spark.createDataFrame(
        [(1, "A", "http://a", "", "x"), (2, "B", "HTTPS://B", "", ""), (3, "C", "http://c", "0311111111", ""),
         (4, "D", "", "", "")], "id long, name string, website string, website_phone string, website_phone2 string"),
        dt.datetime(2026, 1, 1))
    pages_ = site(spark, [(1, 1, "http://a", '<a href="tel:0123456789">t</a>', ""),
                          (3, 1, "http://c", "<p>none</p>", "")])
    cand = VF.website_candidates(leads, "all")
    assert sorted(r["id"] for r in cand.collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in VF.website_candidates(leads, "unverified").collect()) == [1, 2]
    res = VF.verify_websites(cand, pages_)
    assert sorted((r["id"], r["website_phone"]) for r in res.collect()) == [(1, "0123456789"), (3, "")]
    out = {r["id"]: r for r in VF.apply_site_phones(leads, res, dt.datetime(2026, 2, 1)).collect()}
    assert out[1]["website_phone"] == "0123456789" and out[1]["website_phone2"] == ""
    assert out[3]["website_phone"] == "0311111111"       # a re-check never clears
    m = VF.verify_metrics(leads, res).first()
    assert (m["has_website"], m["verified"], m["not_verified"], m["checked"], m["found"], m["saved"]) == \
        (3, 1, 2, 2, 1, 1)


def test_text_phones_windows(spark):
    text = "x" * 70 + " call 012-345 6789 and " + "y" * 5 + "\n+6012 3456789"
    d = spark.createDataFrame([(1, text), (2, None), (3, "none here")], "doc_id long, text string")
    out = sorted((r["pos"], r["raw"], r["context"]) for r in VF.text_phones(d).collect())
    s = text.index("012-345")
    first = out[0]
    assert first[1] == "012-345 6789 " and first[2] == text[s - 60:s + len(first[1]) + 20]
    assert out[1][1] == "+6012 3456789" and len(out) == 2
