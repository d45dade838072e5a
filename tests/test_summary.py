"""Stored counts of the leads table against the scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import filters as FL, mutations as MU
from leadloom.schemas import LEADS, SESSIONS, conform_leads
from leadloom.sources import leads as LD, summary as SU

AS_OF = dt.datetime(2026, 1, 1)
PHONES = ["mobile", "landline", ""]


def some(spark, ids, source="maps"):
    rows = [(i, f"Firm {i}", "" if i % 3 == 2 else f"01{i}", PHONES[i % 3], [f"{source}, jobs", source, "", " , jobs,jobs "][i % 4], None if i % 5 == 0 else i % 7)
            for i in ids]
    return conform_leads(spark.createDataFrame(rows, "id long, name string, phone string, phone_type string, sources string, session_id long"), AS_OF)


def same_as_the_scan(spark, root):
    table = LD.scan_leads(spark, root)
    sessions = spark.createDataFrame([(i, "s", "q", 1, AS_OF) for i in range(9)], SESSIONS)
    for got, want in [(SU.stats(spark, root), FL.view_stats(table)), (SU.lead_total(spark, root), FL.lead_count(table)),
                      (SU.facets(spark, root), FL.source_facets(table)), (SU.session_counts(spark, root, sessions), MU.current_counts(sessions, table))]:
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r[0] for r in SU.facets(spark, root).collect()] == [r[0] for r in FL.source_facets(table).collect()]


def test_counts_follow_appends_rewrites_and_deletes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LD, "BUCKET_IDS", 50)
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 180)), root)
    same_as_the_scan(spark, root)                          # nothing summarised yet
    assert SU.build(spark, root) == 1 and SU.build(spark, root) == 0
    same_as_the_scan(spark, root)
    LD.commit(some(spark, range(180, 230), "web"), root, append=True)
    same_as_the_scan(spark, root)                          # one commit summarised, one not
    LD.rewrite(spark, root, F.col("id").isin(7, 60), lambda leads: leads.withColumn(
        "sources", F.when(F.col("id").isin(7, 60), "edited").otherwise(F.col("sources"))))
    LD.rewrite(spark, root, F.col("session_id") == 3, lambda leads: leads.where(~F.col("session_id").eqNullSafe(F.lit(3))))
    assert SU.build(spark, root) >= 1
    same_as_the_scan(spark, root)


def test_no_lead_file_is_read(spark, tmp_path):
    root = str(tmp_path / "leads")
    LD.commit(some(spark, range(1, 60)), root)
    SU.build(spark, root)
    files = SU.counts(spark, root).inputFiles()
    assert files and all("/_summary/" in f for f in files)


def test_empty_table_and_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SU.counts(spark, str(tmp_path / "none"))
    root = str(tmp_path / "leads")
    LD.commit(spark.createDataFrame([], LEADS), root)
    SU.build(spark, root)
    assert tuple(SU.stats(spark, root).first()) == (0, 0, 0, 0) and SU.facets(spark, root).collect() == []
