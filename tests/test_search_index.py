"""The posting table against the scan."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators.filters import search
from leadloom.schemas import conform_leads
from leadloom.sources import leads as LD
from leadloom.sources import search_index as SI

AS_OF = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("query, want", [
    ("firm", [["fir", "irm"]]), ("Firm 12|No 4", [[" 12", "fir", "irm", "m 1", "rm "], ["no ", "o 4"]]), ("ab", None), ("abc|de", None),
    ("abc*", None), ("abcd*", [["abc"]]), ("abc+de", [["abc"]]), ("abc?d.efg", [["efg"]]), ("a.b", None), ("(abc)", None), (r"abc\d", None),
    (r"a\.bc", [["a.b", ".bc"]]), ("[xyz]abc", [["abc"]]), ("abcd{2}", [["abc"]]), ("^abc$", [["abc"]]), ("[^]a]abc", None), ("", None)])
def test_required_runs(query, want):
    assert SI.required(query) == (want and [sorted(a) for a in want])


def test_required_runs_are_in_every_match():
    r = random.Random(3)
    for _ in range(3000):
        query = "".join(r.choice(["a", "b", "c", "abc", ".", "*", "+", "?", "|", "[ab]", "^", "$", r"\.", "{2}"]) for _ in range(r.randint(1, 6)))
        try:
            rx = re.compile(query)
        except re.error:
            continue
        grams = SI.required(query)
        if grams:
            for _ in range(20):
                text = "".join(r.choice("abc.") for _ in range(12))
                if rx.search(text):
                    assert any(all(g in text for g in a) for a in grams), (query, text)


def some(spark, ids, word="alpha"):
    return conform_leads(spark.createDataFrame([(i, f"Firm {i} É{word}", f"03-{i:07}", "x.y" if i % 5 else "", None if i % 7 else "note " + str(i)) for i in ids],
                                               "id long, name string, phone string, website string, notes string"), AS_OF)


def test_search_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 100)
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 400)), root)
    assert SI.build(spark, root) == 4 and SI.build(spark, root) == 0

    def same(*queries):
        table = LD.scan_leads(spark, root)
        for q, literal in queries:
            got = sorted(r["id"] for r in SI.search_committed(spark, root, q, literal).collect())
            assert got == sorted(r["id"] for r in search(table, q, literal).collect()), q
    asked = [("firm 12", False), ("éalpha", False), ("firm 1.*alpha|0000077", False), ("note 3[0-9]+", False), ("x.y", True), ("a|firm", False), ("zzz", False),
             ("", False), ("(firm|x) 3", False)]
    same(*asked)
    # an append is found before and after it is indexed; a rewrite indexes what it has written
    LD.commit(some(spark, range(395, 450), "beta").where("id >= 400"), root, append=True)
    same(("beta", False), ("alpha", False))
    LD.rewrite(spark, root, F.col("id") == 5, lambda leads: leads.withColumn("notes", F.when(F.col("id") == 5, "changed").otherwise(F.col("notes"))))
    assert SI.build(spark, root) == 2
    same(("beta", False), ("changed", False), *asked[:3])


def test_only_candidates_are_tested(spark, tmp_path):
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 300)), root)
    SI.build(spark, root)
    ids = SI.candidates(spark, root, LD.current(spark, root)[1], SI.required("firm 123 |0000007"))
    assert sorted(r["id"] for r in ids.collect()) == [7, *range(70, 80), 123]      # '000' and '007' are in 03-0000070 too
    p = SI.search_committed(spark, root, "firm 123 ")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in p and "PushedFilters: [In(gram" in p
