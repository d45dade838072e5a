"""The pipeline on a small corpus, each stage against brute force on its own
input, and the driver contract of the optional queries."""

import hashlib

import pytest
import test_bagminhash
import test_decontam
import test_packing
import test_superkmer
from llm_data import DOC_SCHEMA, docs, empty

import __spark_entry__ as E
import corpus_pipeline as C
from leadloom.llm.common import stage
from leadloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and benchmark of a small corpus as Parquet."""
    import test_langid
    rows = test_langid.rows(80)
    rows += [(200 + k, rows[k][1], rows[k][2], "s", 1) for k in range(10)]
    rows += [(300 + k, rows[20 + k][1] + " extra", rows[20 + k][2], "s", 1) for k in range(6)]
    passage = " ".join(f"the{i}" for i in range(45))
    rows += [(400 + k, rows[40 + k][1] + " " + passage + " " + rows[50 + k][1], "en", "s", 1) for k in range(4)]
    item = " ".join(f"whing{i}" for i in range(14))
    rows += [(500, rows[5][1][:300] + " " + item + " tion " * 30, "en", "s", 1), (501, item, "en", "s", 1),
             (600, None, None, None, None), (601, "", None, None, 0), (602, "12 !!", "en", "s", 5)]
    d = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, [(1, item), (2, None)]


def test_stages_against_brute_force(spark, folder):
    d, rows, items = folder
    names = [c.split()[0] for c in DOC_SCHEMA.split(", ")]
    cur = spark.read.parquet(f"{d}/documents.parquet")
    tables = []
    for name, f in C.STAGES[:-1]:
        cur = stage(f(spark, cur, d), f"test-{name}")
        assert cur.columns == names
        tables.append([tuple(r)[:5] for r in cur.collect()])
    lang, near, cut, clean = tables
    assert {r[0] for r in rows} - {r[0] for r in lang} <= {600, 601, 602} | {r[0] for r in rows if len(r[1] or "") < 60}
    assert {600, 601, 602}.isdisjoint({r[0] for r in lang})
    classes = {c for _, c in test_bagminhash.brute_classes(lang)}
    assert sorted(r[0] for r in near) == sorted(classes)
    want = {x[0]: x[1:] for x in test_superkmer.brute(near, 35)}
    for r in cut:
        kept = (r[1] or "").encode().split()
        assert (len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) == (want[r[0]][0] - want[r[0]][1], want[r[0]][2])
    gone = 0
    before = {r[0]: r[1] for r in cut}
    for r in clean:
        n, hit, *_ = test_decontam.brute(before[r[0]], items)
        assert len(test_decontam.words(r[1])) == n - hit and hit <= 0.5 * n
        gone += hit
    assert gone and {r[0] for r in cut} - {r[0] for r in clean} == {r[0] for r in cut if test_decontam.brute(r[1], items)[1] > 0.5 * len(test_decontam.words(r[1]))}
    from tokenizers import Tokenizer
    from leadloom.llm import packing
    t = Tokenizer.from_file(packing.default_tokenizer())
    test_packing.check(C.STAGES[-1][1](spark, cur, d).collect(), clean, t, packing.CAPACITY)


def test_run_applies_all_stages(spark, folder):
    out = C.run(spark, folder[0])
    assert out.count() > 50 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_documents(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) == set(QUERIES) and E.queries()["pipeline"] is C.run
