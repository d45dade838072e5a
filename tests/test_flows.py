"""End-to-end flows: captured pages -> leads, verify, CSV import and export, commits."""

import csv
import datetime as dt

import pytest

from leadloom.operators import mutations as MU
from leadloom.operators.importer import import_counts
from leadloom.plans import flows
from leadloom.schemas import SESSIONS, TAGS, conform_leads
from leadloom.sources import leads as LD
from pyspark.sql import functions as F

from leadloom.sources.csv_import import read_import_csv
from leadloom.sources.pages import CAPTURED_PAGES, read_captured

AS_OF = dt.datetime(2026, 4, 1)


def captured(spark):
    P = "https://www.google.com/maps/place/"
    rows = [
        (1, "maps_results", "google_maps", 1, 1, "s1", None,
         "<div role='feed'>" + "".join(f"<div><div><a href='{P}{x}'>{x}</a></div></div>" for x in ("alpha", "beta", "tesla"))
         + "</div>", None),
        (2, "maps_place", "google_maps", 0, 0, P + "alpha", None,
         '<h1>Alpha Sdn Bhd</h1><a href="tel:03-1234 5678">c</a>', None),
        (3, "maps_place", "google_maps", 0, 0, P + "beta", None, "<p>no name</p>", None),
        (4, "maps_place", "google_maps", 0, 0, P + "tesla", None, "<h1>Tesla KL</h1>", None),
        (5, "dir_results", "jobstreet", 1, 1, "s2", None,
         '<a href="/companies/alpha-1">ALPHA SDN. BHD.</a><a href="/companies/gamma">Gamma</a>', None),
        (6, "dir_company", "jobstreet", 0, 0, "https://my.jobstreet.com/companies/alpha-1", None, "",
         "Website\nhttp://alpha.my\nCompany size\n11-50"),
        (7, "dir_results", "hiredly", 1, 1, "s3", None, '<a href="/companies/delta">Delta</a>', None),
        (8, "dir_company", "hiredly", 0, 0, "https://my.hiredly.com/companies/delta", None,
         '<a href="https://delta.my">w</a>', "Delta Bhd\nSoftware\nOur Address\nLot 5, Jalan Delta"),
    ]
    return spark.createDataFrame(rows, CAPTURED_PAGES)


def empty_leads(spark):
    return conform_leads(spark.createDataFrame([], "id long, name string"), AS_OF)


def test_collect_merge_save(spark):
    leads = empty_leads(spark)
    sessions = spark.createDataFrame([], SESSIONS)
    r = flows.collect_merge_save(spark, captured(spark), leads, sessions,
                                 ["google_maps", "jobstreet", "hiredly"], "Queries: 1", AS_OF,
                                 blocklist='["tesla"]')
    out = {x["name"]: x for x in r.leads.collect()}
    assert set(out) == {"Alpha Sdn Bhd", "Gamma", "Delta Bhd"}
    a = out["Alpha Sdn Bhd"]
    assert a["sources"] == "google_maps, jobstreet" and a["website"] == "http://alpha.my"
    assert a["company_size"] == "11-50" and a["phone_type"] == "landline" and a["id"] == 1
    assert out["Delta Bhd"]["address"] == "Lot 5, Jalan Delta"
    s = r.sessions.first()
    assert (s["id"], s["result_count"]) == (1, 3)
    assert r.summary.first()["total"] == 3


def test_a_page_captured_twice_is_one_listing(spark):
    pages = captured(spark)
    older = pages.where("page_id = 2").selectExpr("-1L AS page_id", *CAPTURED_PAGES.names[1:7], "'<h1>Old</h1>' AS html", "body_text")
    names = [r["name"] for r in flows.listings_from_captured(pages.unionByName(older)).collect()]
    assert sorted(names) == ["ALPHA SDN. BHD.", "Alpha Sdn Bhd", "Delta Bhd", "Gamma", "Tesla KL"]


def test_no_limits_unless_asked(spark):
    links = "".join(f'<a href="/companies/c{i}">C {i}</a>' for i in range(70))
    rows = [(1, "dir_results", "hiredly", 1, 1, "s", None, links, None)]
    rows += [(10 + i, "dir_company", "hiredly", 0, 0, f"https://my.hiredly.com/companies/c{i}", None, "", f"Company {i}") for i in range(70)]
    pages = spark.createDataFrame(rows, CAPTURED_PAGES)
    assert flows.listings_from_captured(pages).count() == 70
    assert flows.listings_from_captured(pages, max_companies=50).count() == 50


def test_verify_flow_on_captured_pages(spark, tmp_path):
    """Newest home page, contact page by its link, other companies' and other
    kinds' pages left alone."""
    rows = [
        (1, "site_home", "", 0, 0, "http://a.my/", 1, '<p>Old <a href="tel:0311111111">c</a></p>', "x"),
        (2, "site_home", "", 0, 0, "http://a.my/", 1, "<a href='./info/../contact.html'>Contact</a>", "Order 03-2222 3333 here"),
        (3, "site_contact", "", 0, 0, "http://a.my/contact.html", None, '<a href="tel:0322223333">c</a>', "Mobile 012-345 6789"),
        (4, "site_contact", "", 0, 0, "http://a.my/other", 1, '<a href="tel:0377777777">c</a>', ""),
        (5, "site_home", "", 0, 0, "http://b.my/", 2, "<p>Nothing</p>", None),
        (6, "maps_place", "google_maps", 0, 0, "http://a.my/contact.html", None, '<a href="tel:0355555555">c</a>', ""),
    ]
    spark.createDataFrame(rows, CAPTURED_PAGES).write.parquet(f"{tmp_path}/p")
    pages = read_captured(spark, f"{tmp_path}/p")
    assert read_captured(spark, f"{tmp_path}/p", kind="site_contact").count() == 2
    leads = conform_leads(spark.createDataFrame([(1, "A", "http://a.my"), (2, "B", "http://b.my"), (3, "C", "")],
                                                "id long, name string, website string"), AS_OF)
    out, results, metrics = flows.verify_flow(leads, pages, AS_OF)
    got = {r["id"]: r for r in results.collect()}
    assert sorted(got) == [1, 2] and got[2]["website_phone"] == ""
    assert got[1]["all_phones"] == ["0322223333 (high)", "0123456789 (medium)"]
    assert {r["id"]: r["website_phone2"] for r in out.collect()} == {1: "0123456789", 2: "", 3: ""}
    assert (metrics.first()["checked"], metrics.first()["found"]) == (2, 1)


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def test_import_csv_flow(spark, tmp_path):
    write(tmp_path / "in.csv", [["Company", "Phone", "Industry"], ["New Co", "0123456789", "IT"], ["new co.", "1", ""],
                                ["", "2", ""], ["Other", "", ""], ['Foo "Bar" Co', "N/A", "null"], ["NA", "3", "x"], ["a, b", " n/a ", "nan"]])
    f = read_import_csv(spark, str(tmp_path / "in.csv"))
    leads = conform_leads(spark.createDataFrame([(5, "x")], "id long, name string"), AS_OF)
    out, counts, marks = flows.import_flow(f, leads, AS_OF, {"leads": 20})
    got = {r["name"]: r for r in out.collect()}
    assert set(got) == {"x", "New Co", "Other", 'Foo "Bar" Co', "a, b"}
    assert got["New Co"]["phone"] == "0123456789" and got["New Co"]["id"] == 21      # ids below the mark were given out
    assert got["Other"]["id"] == 22 and got["Other"]["session_id"] is None
    assert (got['Foo "Bar" Co']["phone"], got['Foo "Bar" Co']["phone_type"], got['Foo "Bar" Co']["category"]) == ("", "", "")
    assert got["a, b"]["phone"] == "n/a"             # only exact spellings are missing
    assert (counts.first()["imported"], counts.first()["skipped"]) == (4, 3) and marks["leads"] == 24


def test_empty_file_imports_nothing(spark, tmp_path):
    write(tmp_path / "in.csv", [["Company", "Phone"]])
    c = import_counts(read_import_csv(spark, str(tmp_path / "in.csv")), empty_leads(spark)).first()
    assert (c["imported"], c["skipped"]) == (0, 0)


def test_rows_keep_file_order_across_files_and_splits(spark, tmp_path):
    want = []
    for k in range(3):
        rows = [f"n{k}-{i:05d}" for i in range(4000)]
        want += rows
        write(tmp_path / f"part{k}.csv", [["Company"], *[[r] for r in rows]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = read_import_csv(spark, str(tmp_path)).select("ord", "Company").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["ord"] for r in got}) == len(want)
    assert [r["Company"] for r in sorted(got, key=lambda r: r["ord"])] == want


def test_export_round_trip(spark, tmp_path):
    leads = conform_leads(spark.createDataFrame([(1, 'Foo "Bar", Co', "012", ""), (2, "B", "", "t")],
                                                "id long, name string, phone string, tags string"), AS_OF)
    MU.export_csv(leads.coalesce(1), str(tmp_path / "out"), columns=["name", "phone", "tags"])
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert list(csv.reader(text.splitlines())) == [["name", "phone", "tags"], ['Foo "Bar", Co', "012", ""], ["B", "", "t"]]
    assert '""' not in text.replace('""Bar""', "")
    back = read_import_csv(spark, str(tmp_path / "out"))
    assert sorted(r["name"] for r in back.collect()) == ["B", 'Foo "Bar", Co']


def test_commits(spark, tmp_path):
    root = str(tmp_path / "leads")
    leads = lambda ids: conform_leads(spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string"), AS_OF)
    assert LD.current(spark, root) == (0, [], {})
    with pytest.raises(FileNotFoundError):
        LD.scan_leads(spark, root)
    assert LD.commit(leads([1, 2, 3]), root, marks={"leads": 3}) == 1
    first = LD.current(spark, root)[1]
    assert LD.commit(leads([4]), root, append=True, marks={"leads": 4}) == 2
    version, folders, marks = LD.current(spark, root)
    assert version == 2 and folders[0] == first[0] and len(folders) == 2      # an append writes the new rows only
    assert sorted(r["id"] for r in LD.scan_leads(spark, root).collect()) == [1, 2, 3, 4]
    LD.commit(LD.scan_leads(spark, root).where("id < 4"), root, marks={"leads": 3})
    assert sorted(r["id"] for r in LD.scan_leads(spark, root).collect()) == [1, 2, 3]
    assert LD.current(spark, root)[2] == {"leads": 4}                          # marks never fall


def some_leads(spark, ids):
    return conform_leads(spark.createDataFrame([(i, f"n{i}", "") for i in ids], "id long, name string, tags string"), AS_OF)


def test_edits_write_the_buckets_they_touch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 100)
    root = str(tmp_path / "leads")
    LD.commit(some_leads(spark, range(1, 2001)), root)
    LD.commit(some_leads(spark, range(2001, 2051)), root, append=True)
    before = LD.current(spark, root)[1]
    edits = spark.createDataFrame([(i, i, "edited") for i in (5, 7, 150, 151, 2010, 9999, None)], "id long, ord long, notes string")
    want = sorted(MU.apply_edits(LD.scan_leads(spark, root), edits, AS_OF).select("id", "notes").collect())
    version, written = LD.rewrite(spark, root, edits, lambda leads: MU.apply_edits(leads, edits, AS_OF))
    after = LD.current(spark, root)[1]
    assert (version, written) == (3, 3) and len(set(before) - set(after)) == 4          # the last bucket had two folders
    assert sorted(LD.scan_leads(spark, root).select("id", "notes").collect()) == want
    # a bulk tag by a condition, then leads of two buckets deleted: one bucket is left without a folder
    tagged = F.col("id").between(1990, 2005)
    assert LD.rewrite(spark, root, tagged, lambda leads: MU.bulk_tag(leads, "hot", AS_OF, mask=tagged).drop("_changed"))[1] == 2
    assert sorted(r["id"] for r in LD.scan_leads(spark, root).where("tags = 'hot'").collect()) == list(range(1990, 2006))
    gone = F.col("id").between(300, 405)
    assert LD.rewrite(spark, root, gone, lambda leads: leads.where(~gone))[1] == 2
    assert LD.scan_leads(spark, root).count() == 2050 - 106 and not any(f.endswith("=3") for f in LD.current(spark, root)[1])
    assert LD.rewrite(spark, root, F.col("id") > 5000, lambda leads: leads) == (5, 0)
    with pytest.raises(LD.CommitConflict):
        LD.commit(some_leads(spark, [1]), root, base=4)


def test_pages_read_the_newest_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 50)
    root = str(tmp_path / "leads")
    ids = [i for i in range(1, 1000) if i % 3 and not 400 < i < 700]
    LD.commit(some_leads(spark, ids), root)
    want = sorted(ids, reverse=True)
    page = LD.newest_page(spark, root, 20)
    assert [r["id"] for r in page.collect()] == want[:20] and len(page.inputFiles()) == 1
    assert [r["id"] for r in LD.newest_page(spark, root, 30, before=702).collect()] == [i for i in want if i < 702][:30]
    assert [r["id"] for r in LD.newest_page(spark, root, 5000, before=90).collect()] == [i for i in want if i < 90]
    assert LD.newest_page(spark, root, 10, before=0).collect() == []


def test_of_concurrent_commits_one_wins(spark, tmp_path):
    import threading
    root = str(tmp_path / "leads")
    LD.commit(some_leads(spark, [0]), root)
    for k in range(10):
        won, lost = [], []
        start = threading.Barrier(2)

        def job(i):
            start.wait()
            try:
                won.append(LD._publish(spark, root, (k + 2, [f"{root}/{i}"], {})))   # both have read version k + 1
            except LD.CommitConflict:
                lost.append(i)
        threads = [threading.Thread(target=job, args=(i,)) for i in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert won == [k + 2] and len(lost) == 1
        assert LD.current(spark, root)[:2] == (k + 2, [f"{root}/{1 - lost[0]}"])
    assert sorted(p.name for p in (tmp_path / "leads" / "_commits").iterdir() if not p.name.startswith(".")) == [f"{v:012d}.json" for v in range(1, 12)]


def test_ids_are_never_given_out_again(spark, tmp_path):
    root = str(tmp_path / "leads")
    sessions = spark.createDataFrame([], SESSIONS)
    r = flows.collect_merge_save(spark, captured(spark), empty_leads(spark), sessions, ["google_maps"], "q", AS_OF, marks={})
    LD.commit(r.leads, root, marks=r.marks)
    stored = LD.scan_leads(spark, root)
    kept, kept_sessions, _ = MU.delete_session(stored, r.sessions, 1)
    LD.commit(kept, root)
    again = flows.collect_merge_save(spark, captured(spark), LD.scan_leads(spark, root), kept_sessions, ["google_maps"], "q",
                                     AS_OF, marks=LD.current(spark, root)[2])
    n = stored.count()
    assert [x["id"] for x in again.sessions.collect()] == [2]
    assert sorted(x["id"] for x in again.new_leads.collect()) == list(range(n + 1, 2 * n + 1))
    assert again.marks == {"leads": 2 * n, "sessions": 2}
    tags = MU.add_tags(spark.createDataFrame([], TAGS), spark.createDataFrame([("a",)], "name string"), AS_OF, high_water=9)
    assert [t["id"] for t in tags.collect()] == [10]
    assert MU.seed_tags(spark, spark.createDataFrame([], TAGS), AS_OF).count() == 0 and MU.seed_tags(spark, None, AS_OF).count() == 5
    assert [t["name"] for t in MU.list_tags(MU.delete_tag(MU.seed_tags(spark, None, AS_OF), "重要客戶")).collect()] == sorted(
        ["已打電話", "有興趣", "不要再打", "待跟進"])
