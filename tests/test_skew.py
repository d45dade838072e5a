"""A key that holds a third of all rows: results equal a DuckDB query over the
same rows, and the plans reduce the hot group map-side."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from leadloom.operators import verify as VF
from leadloom.operators.dedupe import dedupe_leads, dedupe_removed
from leadloom.operators.importer import import_leads
from leadloom.operators.merge import merge_listings
from leadloom.schemas import conform_leads

N = 3000
COLS = ["ord", "source", "name", "phone", "website", "address"]


def skewed_rows():
    rows = []
    for i in range(N):
        hot = i % 3 == 0
        name = ("HOT Co Sdn Bhd" if i % 2 else "Hot Co") if hot else f"Firm {i}"
        phone = "" if i % 5 else ("012-%07d" % i if i % 10 == 0 else "03-%07d" % i)
        web = "http://x%d.my" % i if i % 7 == 0 else ("www.x.my" if i % 4 == 0 else "")
        rows.append((N - i, ["a", "b", "c"][i % 3], name, phone, web, "Addr %d" % i if i % 11 == 0 else ""))
    return rows


@pytest.fixture
def con():
    c = duckdb.connect()
    c.register("raw", pd.DataFrame(skewed_rows(), columns=COLS))
    # the names used here differ in case and one suffix only
    c.execute("CREATE VIEW listings AS SELECT *, trim(replace(lower(name), 'sdn bhd', '')) AS k FROM raw")
    return c


def test_merge_hot_key(spark, con):
    df = spark.createDataFrame(skewed_rows(), "ord long, source string, name string, phone string, website string, "
                                              "address string").repartition(6)
    out = merge_listings(df)
    got = sorted(tuple(r) for r in out.select("name_key", "name", "phone", "website", "address", "sources").collect())
    want = con.execute("""
        SELECT k, arg_min(name, ord),
          coalesce(arg_min(phone, ord) FILTER (WHERE phone LIKE '01%'), arg_min(phone, ord) FILTER (WHERE phone <> ''), ''),
          coalesce(arg_min(website, ord) FILTER (WHERE website LIKE 'http%'), arg_min(website, ord)),
          coalesce(arg_min(address, ord) FILTER (WHERE address <> ''), ''),
          (SELECT string_agg(source, ', ' ORDER BY o) FROM (SELECT source, min(ord) AS o FROM listings i WHERE i.k = l.k GROUP BY source))
        FROM listings l GROUP BY k""").fetchall()
    assert got == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_dedupe_hot_key(spark, con):
    rows = [(N - o, n, p, w, a, "") for (o, _s, n, p, w, a) in skewed_rows()] + [(9001, "", "1", "", "", ""), (9002, "!!", "", "", "", "")]
    leads = conform_leads(spark.createDataFrame(
        rows, "id long, name string, phone string, website string, address string, tags string"),
        dt.datetime(2026, 1, 1)).repartition(6)
    keep = [r[0] for r in con.execute("""
        SELECT arg_min(id, (-score, id)) FROM (SELECT k, 3000 - ord AS id, CASE WHEN phone <> '' THEN 2 ELSE 0 END
          + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END AS score FROM listings)
        GROUP BY k""").fetchall()]
    out = dedupe_leads(leads)
    assert sorted(r["id"] for r in out.collect()) == sorted([*keep, 9001, 9002])   # empty keys stay
    assert dedupe_removed(leads).count() == N - len(keep)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_building_dedupe_runs_no_job(spark):
    leads = conform_leads(spark.range(100).selectExpr("id", "'a' AS name"), dt.datetime(2026, 1, 1))
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job may run")
    dedupe_leads(leads)
    dedupe_removed(leads)
    assert not sc.statusTracker().getJobIdsForGroup("building")


def test_import_hot_key(spark, con):
    f = spark.createDataFrame(skewed_rows(), ", ".join(f"{c} string" if c != "ord" else "ord long" for c in COLS)).repartition(6)
    stored = conform_leads(spark.createDataFrame([(1, "firm 1"), (2, "Other")], "id long, name string"), dt.datetime(2026, 1, 1))
    got = sorted((r["ord"], r["name"]) for r in import_leads(f, stored).collect())
    want = con.execute("SELECT min(ord), arg_min(name, ord) FROM listings WHERE k <> 'firm 1' GROUP BY k").fetchall()
    assert got == sorted(want)


def test_hot_company_and_pages_of_no_company(spark):
    rows = [(7, k % 2 + 1, f"<p>Call <a href='tel:03-1234{k % 5:04d}'>x</a></p>", "") for k in range(900)]
    rows += [(None, 1, "<a href='tel:0311112222'>x</a>", "")] * 900 + [(8, 1, "", "Tel 03-9999 8888 now")] * 900
    pages = spark.createDataFrame(rows, "company_id long, page_ord int, html string, body_text string").repartition(6)
    out = VF.company_phones(pages)
    got = sorted((r["company_id"], r["phone"], r["confidence"]) for r in out.collect())
    assert got == sorted([(7, f"031234{k:04d}", "high") for k in range(5)] + [(8, "0399998888", "medium")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # map-side aggregation before the first exchange
    assert plan.rindex("partial_min") > plan.rindex("Exchange hashpartitioning")
