"""Dedupe, import, filters, mutations."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leadloom.operators import filters as FL
from leadloom.operators import mutations as MU
from leadloom.operators.dedupe import dedupe_leads, dedupe_removed
from leadloom.operators.importer import import_counts, import_leads
from leadloom.schemas import conform_leads
from leadloom.sources.blocklist import blocklist_pattern, entries_frame, entries_from_text
from leadloom.sources.leads import fixture_leads
from tests.conftest import rows

AS_OF = dt.datetime(2026, 3, 1)
SF = "/root/testdata/sf0.001"


def leads(spark, data, cols="id long, name string, phone string, website string, address string, "
                            "category string, tags string, session_id long"):
    return conform_leads(spark.createDataFrame(data, cols), AS_OF)


def test_dedupe_keeps_most_complete_then_lowest_id(spark):
    df = leads(spark, [
        (1, "Alpha Sdn Bhd", "", "w", "", "", "", 1),
        (2, "ALPHA", "012", "", "", "", "", 1),       # score 2 (phone)
        (3, "alpha", "", "w", "a", "", "", 1),        # score 2 (website + address) -> tie, higher id
        (4, "!!!", "", "", "", "", "", None),         # empty key: untouched
        (5, "", "", "", "", "", "", None),            # empty key: untouched
        (6, "Beta", "", "", "", "", "", 2),
    ])
    assert sorted(r["id"] for r in dedupe_leads(df).collect()) == [2, 4, 5, 6]
    assert sorted(r["id"] for r in dedupe_removed(df).collect()) == [1, 3]


def test_dedupe_algebra(spark):
    l = fixture_leads(spark, SF)
    once = dedupe_leads(l)
    assert once.count() + dedupe_removed(l).count() == l.count()
    assert rows(dedupe_leads(once), "id") == rows(once, "id")


def test_import_rules(spark):
    stored = leads(spark, [(1, "Alpha Sdn Bhd", "", "", "", "", "", 1)])
    f = spark.createDataFrame([
        (1, " New Co ", "0123456789", "nan", "Jalan 1", "retail"),
        (2, "alpha", "1", "", "", ""),            # key exists in leads
        (3, "New Co.", "2", "", "", ""),          # same key earlier in file
        (4, "", "3", "", "", ""), (5, "nan", "4", "", "", ""), (6, None, "5", "", "", ""),
        (7, "!!!", "6", "", "", ""), (8, "???", "7", "", "", ""),   # '' key: first one imported
        (9, "Other", None, None, None, None),
    ], "ord long, Company string, Phone string, Website string, Address string, Industry string")
    out = {r["ord"]: r for r in import_leads(f, stored).collect()}
    assert sorted(out) == [1, 7, 9]
    assert out[1]["name"] == "New Co" and out[1]["phone"] == "0123456789"   # leading zero kept
    assert out[1]["website"] == "" and out[1]["category"] == "retail" and out[1]["sources"] == "imported"
    assert out[1]["phone_type"] == "mobile" and out[9]["phone"] == ""
    c = import_counts(f, stored).first()
    assert (c["imported"], c["skipped"]) == (3, 6)


def test_import_limit_and_counts(spark):
    l = fixture_leads(spark, SF)
    from leadloom.sources.fixtures import fixture
    f = fixture(spark, SF, "import_file")
    c = import_counts(f, l, max_rows=500).first()
    assert c["imported"] + c["skipped"] == min(f.count(), 500)


def test_import_rename_target_wins(spark):
    f = spark.createDataFrame([(1, "A", "B")], "ord long, name string, Company string")
    stored = leads(spark, [(9, "zzz", "", "", "", "", "", 1)])
    assert import_leads(f, stored).first()["name"] == "A"


def test_blocklist(spark):
    assert blocklist_pattern([]) is None and blocklist_pattern(["  ", ""]) is None
    pat = blocklist_pattern(json.dumps(["ey ", "a&w ", "b.i.g.", "dôme"]))
    df = spark.createDataFrame([(1, "google_maps", "Moneyline"), (2, "google_maps", "A&W Bangsar"),
                                (3, "google_maps", "BIG shop"), (4, "google_maps", "B.I.G. Store"),
                                (5, "google_maps", "DÔME Cafe"), (6, "jobstreet", "Money Co")],
                               "ord long, source string, name string")
    assert sorted(r["ord"] for r in FL.not_blocked(df, pat).collect()) == [3, 6]
    kept = FL.not_blocked(df, blocklist_pattern(["ey "], keep_spaces=True))
    assert 1 in [r["ord"] for r in kept.collect()]
    assert FL.not_blocked(df, pat, enabled=False).count() == 6
    e = entries_frame(spark.createDataFrame([(json.dumps([" a ", "", "  ", "b"]),), (None,), ("[]",)], "value string"))
    assert [(r["pos"], r["entry"]) for r in e.orderBy("pos").collect()] == [(0, "a"), (3, "b")]
    assert entries_from_text(" x \n\n y\n") == ["x", "y"]


def test_filters_and_stats(spark):
    df = leads(spark, [(1, "Firm A", "012", "", "Bangsar", "", "called", 1),
                       (2, "Firm B", "  ", "", "", "", "", 1),
                       (3, "C", None, "", "", "", "interested, called", 2)])
    df = df.withColumn("phone_type", F.when(F.col("id") == 1, "mobile").otherwise(""))
    assert [r["id"] for r in FL.search(df, "FIRM").collect()] == [1, 2]
    assert [r["id"] for r in FL.search(df, "b|^c$").orderBy("id").collect()] == [1, 2, 3]
    assert [r["id"] for r in FL.search(df, "^c$").collect()] == [3]
    assert FL.search(df, "c++", literal=True).count() == 0
    assert [r["id"] for r in FL.phone_filter(df, "no_phone").orderBy("id").collect()] == [2, 3]
    assert FL.tag_filter(df, "called").count() == 2
    s = FL.view_stats(df).first()
    assert (s["showing"], s["mobile"], s["landline"], s["no_phone"]) == (3, 1, 0, 2)
    with pytest.raises(ValueError):
        FL.phone_filter(df, "fax")
    with pytest.raises(ValueError):
        FL.project(df, ["secret"])
    assert FL.project(df, ["name", "tags"]).columns == ["id", "name", "tags"]


def test_filter_plan_prunes_columns(spark, tmp_path):
    p = str(tmp_path / "leads")
    fixture_leads(spark, SF).write.parquet(p)
    v = FL.project(FL.tag_filter(spark.read.parquet(p), "called"), ["name", "tags"])
    plan = v._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "notes" not in schema and "hiredly_url" not in schema
    assert "PushedFilters" in plan


def test_edits(spark):
    df = leads(spark, [(1, "A", "011", "", "", "", "", 1), (2, "B", "", "", "", "", "", 1)])
    df = df.withColumn("phone_type", F.lit("mobile"))
    edits = spark.createDataFrame([(1, 1, "03-1", None, "x"), (2, 1, "03-2", "n", "y"),
                                   (3, None, "9", "z", "z"), (4, 99, "1", "1", "1")],
                                  "ord long, id long, phone string, notes string, website_phone2 string")
    out = {r["id"]: r for r in MU.apply_edits(df, edits, AS_OF).collect()}
    assert out[1]["phone"] == "03-2" and out[1]["notes"] == "n"
    assert out[1]["phone_type"] == "mobile"           # editing phone does not reclassify
    assert out[1]["website_phone2"] == ""             # not in the write whitelist
    assert out[2]["phone"] == "" and out[2]["updated_at"] == AS_OF
    assert MU.edit_count(edits).first()["edited"] == 3


def test_bulk_tag(spark):
    df = leads(spark, [(1, "A", "", "", "", "", "called", 1), (2, "B", "", "", "", "", "", 1),
                       (3, "C", "", "", "", "", "vip", 1)])
    out = {r["id"]: r for r in MU.bulk_tag(df, "call", AS_OF, ids=df.where("id < 3")).collect()}
    assert out[1]["tags"] == "called" and not out[1]["_changed"]      # substring test
    assert out[2]["tags"] == "call" and out[2]["_changed"]
    assert out[3]["tags"] == "vip" and not out[3]["_changed"]
    ex = {r["id"]: r for r in MU.bulk_tag(df, "call", AS_OF, exact=True).collect()}
    assert ex[1]["tags"] == "called, call" and ex[3]["tags"] == "vip, call"


def test_sessions(spark):
    df = leads(spark, [(1, "A", "", "", "", "", "", 1), (2, "B", "", "", "", "", "", None),
                       (3, "C", "", "", "", "", "", 2)])
    sessions = MU.create_session(spark, spark.createDataFrame([], "id long, sources string, "
                                 "query_info string, result_count long, created_at timestamp"),
                                 ["google_maps", "jobstreet"], "Queries: 2", 3, AS_OF)
    assert sessions.first()["id"] == 1 and sessions.first()["sources"] == "google_maps, jobstreet"
    kept, s2, deleted = MU.delete_session(df, sessions, 1)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]           # NULL session stays
    assert deleted.count() == 1 and s2.count() == 0
    assert [r["id"] for r in MU.session_detail(df, 2).collect()] == [3]


def test_ids_dense_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = MU.assign_ids(df, ["k"], 100)
    got = sorted((r["k"], r["id"]) for r in out.collect())
    assert got == [(k, 100 + k) for k in range(1000)]


def test_tags(spark):
    t = MU.seed_tags(spark, None, AS_OF)
    assert t.count() == 5
    t2 = MU.add_tags(t, spark.createDataFrame([(" vip ",), ("vip",), ("已打電話",)], "name string"), AS_OF)
    assert t2.count() == 6 and t2.where("name = 'vip'").first()["id"] == 6
    assert MU.seed_tags(spark, t2, AS_OF).count() == 6                 # seeded once only
    assert MU.delete_tag(t2, "vip").count() == 5


def test_save_and_export(spark, tmp_path):
    from leadloom.operators.merge import merge_listings
    from leadloom.sources.fixtures import fixture
    l = fixture_leads(spark, SF)
    merged = merge_listings(fixture(spark, SF, "listings"))
    after = MU.save_listings(l, merged, 7, AS_OF)
    assert after.count() == l.count() + merged.count()
    new = after.where("session_id = 7")
    assert new.agg(F.min("id")).first()[0] == l.agg(F.max("id")).first()[0] + 1
    with pytest.raises(ValueError):
        MU.export_view(l, columns=["name", "secret"])
    out = str(tmp_path / "export")
    MU.export_csv(l, out, phone="mobile")
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["name", "phone", "phone_type", "website_phone", "website", "address",
                            "category", "company_size", "tags"]
    assert back.count() == l.where("phone_type = 'mobile'").count()


def test_order_invariance_dedupe_and_import(spark):
    from leadloom.sources.fixtures import fixture
    l = fixture_leads(spark, SF)
    shuffled = l.repartition(5).orderBy(F.rand(7))
    assert rows(dedupe_leads(l), "id") == rows(dedupe_leads(shuffled), "id")
    f = fixture(spark, SF, "import_file")
    f2 = f.repartition(3).orderBy(F.rand(11))
    assert rows(import_leads(f, l)) == rows(import_leads(f2, shuffled))


def test_blocklist_as_a_join_equals_the_pattern(spark):
    import random
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé .&") for _ in range(r.randint(1, 7)))
    entries = [e for e in (word().strip() for _ in range(60)) if e] + ["", "  ", "a", "B.", "Big Co"]
    names = [word().title() + word() for _ in range(300)] + [None, "", "the BIG CO ltd", "xa"]
    df = spark.createDataFrame([(i, r.choice(["google_maps", "hiredly"]), n) for i, n in enumerate(names)], "ord long, source string, name string")
    for some in (entries, entries[:10], ["Big Co"], ["", " "]):
        listed = spark.createDataFrame([(e,) for e in some], "entry string")
        want = sorted(x["ord"] for x in FL.not_blocked(df, blocklist_pattern(some)).collect())
        assert sorted(x["ord"] for x in FL.not_blocked_by(df, listed).collect()) == want
    assert FL.not_blocked_by(df, listed, enabled=False).count() == len(names)
