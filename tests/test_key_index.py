"""Stored name keys of the leads table against the operators over frames."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.operators.dedupe import dedupe_leads, dedupe_removed
from leadloom.operators.importer import import_counts, import_leads
from leadloom.schemas import LEADS, conform_leads
from leadloom.sources import key_index as KI, leads as LD

AS_OF = dt.datetime(2026, 1, 1)


def some(spark, ids, firms=40):
    """Leads of which half share one name; some without a name or with a key that is empty."""
    name = lambda i: "Hot Firm Sdn Bhd" if i % 2 else [f"Firm {i % firms}", f"FIRM {i % firms}!", "", "!!", None][i % 5]
    data = [(i, name(i), "0123" if i % 3 else "", "http://x" if i % 7 == 0 else "", "a" if i % 4 else None) for i in ids]
    return conform_leads(spark.createDataFrame(data, "id long, name string, phone string, website string, address string"), AS_OF)


def file_of(spark, names):
    return spark.createDataFrame([(i, n, "1") for i, n in enumerate(names)], "ord long, Company string, Phone string")


FILE = ["hot firm", "Firm 2", "New One", "NEW one", "", None, "nan", "??", "Firm 999", "New Two", "Late 7"]


def same_as_the_scan(spark, root):
    table, file = LD.scan_leads(spark, root), file_of(spark, FILE)
    assert rows(KI.import_committed(spark, root, file)) == rows(import_leads(file, table))
    assert rows(KI.import_committed(spark, root, file, 4)) == rows(import_leads(file, table, 4))
    assert rows(KI.import_counts_committed(spark, root, file)) == rows(import_counts(file, table))
    assert KI.removable(spark, root).first()["leads"] == dedupe_removed(table).count()


def test_keys_follow_appends_rewrites_and_deletes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 50)
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 180)), root)
    same_as_the_scan(spark, root)                          # nothing stored yet
    assert KI.build(spark, root) == 1 and KI.build(spark, root) == 0
    same_as_the_scan(spark, root)
    LD.commit(some(spark, range(180, 230), 7), root, append=True)
    same_as_the_scan(spark, root)                          # one commit stored, one not
    LD.rewrite(spark, root, F.col("id") == 60, lambda leads: leads.withColumn(
        "name", F.when(F.col("id") == 60, "Late 7").otherwise(F.col("name"))))
    assert KI.build(spark, root) == 2
    same_as_the_scan(spark, root)


def test_dedupe_writes_the_buckets_that_lose_leads_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 50)
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 100)), root)
    single = [(i, f"Single {i}", "") for i in range(100, 150)]
    LD.commit(conform_leads(spark.createDataFrame(single, "id long, name string, phone string"), AS_OF), root, append=True)
    KI.build(spark, root)
    table = LD.scan_leads(spark, root)
    want = rows(dedupe_leads(table))
    assert tuple(KI.removable(spark, root).first()) == (2, table.count() - len(want))
    assert KI.dedupe_committed(spark, root) == (3, 2)
    assert rows(LD.scan_leads(spark, root)) == want
    KI.build(spark, root)
    assert tuple(KI.removable(spark, root).first()) == (0, 0)
    assert KI.dedupe_committed(spark, root) == (3, 0)      # nothing to do: no commit


def test_an_import_reads_no_lead_file(spark, tmp_path):
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 60)), root)
    KI.build(spark, root)
    for df in (KI.import_committed(spark, root, file_of(spark, FILE)), KI.removable(spark, root)):
        assert df.inputFiles() and all("/_keys/" in f for f in df.inputFiles())


def test_a_small_file_leaves_the_stored_keys_where_they_are(spark, tmp_path):
    import re
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 60)), root)
    KI.build(spark, root)
    df = KI.import_committed(spark, root, file_of(spark, FILE))
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    final = p[:p.index("Initial Plan")] if "Initial Plan" in p else p
    assert re.search(r"BroadcastHashJoin[^\n]*LeftSemi, BuildRight", final), final


def test_commits_between_keys_and_rewrite_conflict(spark, tmp_path):
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 20)), root)
    with pytest.raises(LD.CommitConflict):
        LD.rewrite(spark, root, F.col("id") == 1, lambda leads: leads, base=0)


def test_empty_table_and_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KI.entries(spark, str(tmp_path / "none"))
    root = str(tmp_path / "leads")
    LD.commit(spark.createDataFrame([], LEADS), root)
    KI.build(spark, root)
    same_as_the_scan(spark, root)
    assert KI.dedupe_committed(spark, root) == (1, 0)
