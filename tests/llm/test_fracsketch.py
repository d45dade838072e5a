import hashlib

import pytest
from llm_data import doc_rows, docs, empty

from leadloom.llm import fracsketch as K


def shingles(t):
    w = (t or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def unique_ids(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] not in seen:
            out.append(r)
        seen.add(r[0])
    return out


@pytest.mark.parametrize("block_rows", [256, 3])
def test_report_against_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    rows = unique_ids(doc_rows())
    got = {r["doc_id"]: r for r in K.report(docs(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    err = []
    for k, r in enumerate(order):
        t, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        x = got[r[0]]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        if t == edited:
            assert x["near_edited"] == 1 and x["fingerprint"] == x["edited_fingerprint"]
        if t == after:
            assert x["near_next"] == 1
        if not a & c and t != after:
            assert x["near_next"] == 0
        if min(len(a), len(b)) > 60:
            err.append(x["near_edited"] - len(a & b) / min(len(a), len(b)))
        if len(a) > 2000:                                # the kept share of all shingles
            assert abs(len(x["fingerprint"].split()) / len(a) - 1 / K.SCALE) < 0.03
    assert abs(sum(err) / len(err)) < 0.05 and max(map(abs, err)) < 0.5


def test_sketches_merge_by_union(spark):
    from pyspark.sql import functions as F
    a, b = "one two three four five six seven eight " * 3, "nine ten eleven twelve thirteen fourteen " * 2
    df = spark.createDataFrame([(a, b, a + b)], "a string, b string, c string").select(*[K.sketch(F.col(c)).alias(c) for c in "abc"])
    r = df.first()
    assert set(r["a"]) | set(r["b"]) <= set(r["c"]) and r["c"] == sorted(set(r["c"]))


def test_equal_texts_have_equal_fingerprints_in_any_spacing(spark):
    rows = [(1, "A b  c d e f g", "en", "s", 1), (2, "a B c\nd e f g ", "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    got = {r["doc_id"]: r["fingerprint"] for r in K.report(docs(spark, rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] == ""


def test_no_python_in_the_plan(spark):
    plan = K.report(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_ids_single_row_and_empty_table(spark):
    assert len(K.report(docs(spark)).collect()) == len(doc_rows())
    one = K.report(docs(spark, [(5, "abcdef", None, None, None)])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1
    assert K.report(empty(spark)).collect() == []


@pytest.mark.parametrize("ids", [
    [*range(300), 1 << 62], [-(1 << 63), *range(200), (1 << 63) - 1], [2 ** k for k in range(62)], [7] * 200, [None] * 150 + [1, 2],
    [*range(50), *range(1 << 40, (1 << 40) + 50), *[9] * 120]])
def test_blocks_are_small_however_the_ids_are_spread(spark, ids, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    rows = spark.createDataFrame([(i, hash((k, "t"))) for k, i in enumerate(ids)], "doc_id long, _tie long").repartition(4)
    out, spans = K.in_blocks(rows)
    assert max(r["n"] for r in spans.collect()) <= 32
    placed = sorted((r["_block"], r["doc_id"] is not None, r["doc_id"] or 0, r["_tie"]) for r in out.collect())
    assert [x[1:] for x in placed] == sorted((i is not None, i or 0, hash((k, "t"))) for k, i in enumerate(ids))
    assert [x[1:] for x in placed] == sorted(x[1:] for x in placed)
    before = {tuple(r["_own"]): tuple(r["_before"]) for r in K._before(spans).collect()}
    blocks = sorted({tuple(x[0]) for x in placed})
    assert before == {b: blocks[k - 1] for k, b in enumerate(blocks)}
