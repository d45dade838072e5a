import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import doc_rows, docs, empty

from leadloom.llm import mixture as M


def brute_targets(sizes, weights, ceiling=3):
    full, total = set(), sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(ceiling * sizes[i] for i in full)
        w = sum(weights[i] for i in rest)
        over = [i for i in rest if left * weights[i] > ceiling * sizes[i] * w]
        if not over:
            return [float(ceiling * s) if i in full else left * weights[i] / w for i, s in enumerate(sizes)]
        full |= set(over)


def brute_seats(targets, house):
    seats = [0] * len(targets)
    for _ in range(house):
        i = max((t / (2 * k + 1), -i) for i, (t, k) in enumerate(zip(targets, seats, strict=True)) if t > 0)[1]
        seats[-i] += 1
    return seats


SOURCES = [[5], [100, 3, 50], [1000, 1, 0, 7, 20, 900], [40, 40, 40, 40], [0, 0, 9], [1, 1, 1, 100000]]


@pytest.mark.parametrize("sizes", SOURCES)
def test_targets_and_quotas(spark, sizes):
    weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    rows = spark.createDataFrame(list(zip(range(len(sizes)), weights, sizes)), "ord int, weight long, source_size long")
    planned = M.targets(rows)
    got = {r["ord"]: r["target"] for r in planned.collect()}
    want = brute_targets(sizes, weights)
    assert [got[i] for i in range(len(sizes))] == pytest.approx(want)
    assert sum(want) == pytest.approx(sum(sizes))
    block = max(1, min(M.BLOCK_MAX, int(min(t for t in want if t > 0) // M.BLOCKS_LEAST)))
    blocks = math.floor(sum(want) / block + 0.5)
    if blocks > 20_000:
        block = None                                            # brute force is one pass per block
    out = {r["ord"]: r for r in M.quotas(planned, 5).collect()}
    assert set(out) == {i for i, t in enumerate(want) if t > 0}
    if block:
        for h in range(5):
            seats = brute_seats([got[i] for i in range(len(sizes))], blocks * (h + 1) // 5)
            assert {i: r["ends"][h] for i, r in out.items()} == {i: s for i, s in enumerate(seats) if want[i] > 0}
    assert sum(r["ends"][-1] for r in out.values()) == blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12))
def test_brute_targets_keep_the_total(sizes):
    t = brute_targets(sizes, [M.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s for x, s in zip(t, sizes, strict=True))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_ROWS", 25)                     # several chunks a source
    rows = doc_rows(9, 300)
    got = M.mix(docs(spark, rows).repartition(5), shards=4).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())                       # noqa: E731  (the texts hold no other white space)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(g["size"] for g in got if g["source"] == s) for s in names]
    for s, n, t in zip(names, sizes, brute_targets(sizes, [1, 2, 3]), strict=True):
        of = [g for g in got if g["source"] == s]
        assert of and all(g["source_size"] == n and g["target"] == pytest.approx(t) for g in of)
        taken = sum(x["n"] for g in of for x in g["spans"])
        assert abs(taken - t) <= 2 * of[0]["block"]
        for h in range(4):                                       # every shard has its part
            part = sum(x["n"] for g in of for x in g["spans"] if x["shard"] == h)
            assert abs(part - t / 4) <= 3 * of[0]["block"]
        for g in of:
            words = {}
            for x in g["spans"]:
                assert 0 <= x["start"] and x["start"] + x["n"] <= g["size"]
                for p in range(x["start"], x["start"] + x["n"]):
                    words[p] = words.get(p, 0) + 1
            laps = [words.get(p, 0) for p in range(g["size"])]
            assert not laps or max(laps) - min(laps) <= 1 and max(laps) <= 3
    assert sorted((g["doc_id"] or -1, g["size"]) for g in got) == sorted((r[0] or -1, size(r[1]) if r[1] is None or "　" not in r[1] else
                                                                         g_size(got, r[0])) for r in rows)
    again = M.report(docs(spark, rows).repartition(3)).collect()
    assert sorted(again, key=str) == sorted(M.report(docs(spark, rows)).collect(), key=str)


def g_size(got, doc_id):
    return next(g["size"] for g in got if g["doc_id"] == doc_id)


def test_hot_source_ties_and_none(spark):
    rows = [(i, "a b c", None, "big" if i % 3 else f"s{i % 7}", None) for i in range(300)]
    out = M.report(docs(spark, rows)).collect()
    assert len(out) == 300 and all(0 <= r["taken"] <= 9 for r in out)
    assert M.mix(empty(spark)).collect() == []
    blank = M.report(docs(spark, [(1, None, None, None, None), (2, "", None, "x", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_plan_is_native(spark):
    plan = M.report(docs(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
