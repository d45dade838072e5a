import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import doc_rows, docs, empty

from leadloom.llm import sharding as S


def brute_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(r, k) for k, r in enumerate(left) if r >= sizes[i]]
        if not fit:
            left.append(max(capacity, sizes[i]))
            fit = [(left[-1], len(left) - 1)]
        out[i] = min(fit)[1]
        left[out[i]] -= sizes[i]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 100))
def test_tree_finds_the_tightest_bin(sizes, capacity):
    assert S.best_fit_decreasing(np.array(sizes, dtype=np.int64), capacity).tolist() == brute_fit(sizes, capacity)


@pytest.mark.parametrize("bins", [1, 7, 40])
def test_even_bins(bins):
    g = np.random.default_rng(bins)
    sizes = np.concatenate([[10 ** 7], g.integers(1, 5000, 3000)])
    got = np.bincount(S.even_bins(sizes, bins), weights=sizes, minlength=bins)
    assert len(got) == bins
    if bins > 1:
        rest = np.sort(got)[:-1]
        assert got.max() == 10 ** 7 and rest.max() - rest.min() <= 0.01 * rest.mean()


def test_shards(spark):
    rows = doc_rows(3, 400)
    out = S.shard(docs(spark, rows).repartition(4), shards=5).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    by_text, slots, load = {}, {}, np.zeros(5)
    for r in out:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in rows:
        groups[r[1] or ""] = groups.get(r[1] or "", 0) + size(r[1])
    top = max(groups.values())
    others = np.sort(load)[:-1] if top > load.sum() / 5 else load
    assert others.max() - others.min() <= 0.02 * others.mean()
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}


def test_fewer_groups_than_shards_and_none(spark):
    out = S.shard(docs(spark, [(1, "x", None, None, None), (2, "x", None, None, None), (3, None, None, None, None)]), shards=40).collect()
    assert len({r["shard"] for r in out}) == 2
    assert S.shard(empty(spark)).collect() == []


def test_groups_are_packed_in_portions(spark, monkeypatch):
    """Many more groups than a task packs at a time: shards stay even, slots gapless."""
    monkeypatch.setattr(S, "GROUPS", 50)
    rows = [(i, f"text {i} " * (1 + i % 9), None, None, None) for i in range(2000)] + [(5000 + i, "same", None, None, None) for i in range(40)]
    out = S.shard(docs(spark, rows).repartition(2), shards=4).collect()
    load, slots = np.zeros(4), {}
    for r in out:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 2040 and load.max() - load.min() <= 0.02 * load.mean()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in out if r["doc_id"] >= 5000}) == 1
