import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import doc_rows, docs, empty

from leadloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.default_tokenizer())


def test_ids_equal_the_tokenizers_library(tokenizer):
    enc = P.ChunkEncoder(P.default_tokenizer())
    texts = [r[1] or "" for r in doc_rows()] + [" ", "  a  b\n\n c\t d", "I'm  'll go", "x<|endoftext|>y", "a b 　c", "12ab, 3.4!?"]
    for t in texts:
        assert np.frombuffer(enc.ids(t), dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_cut_is_full_but_for_the_first_piece():
    assert P.cut(10, 10) == [(0, 10)]
    assert P.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert P.cut(20, 10) == [(0, 10), (10, 10)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_uses_every_item_once_and_never_overflows(counts):
    plan = P.best_two_fit(counts, 30)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 30 and times > 0
        for x in lengths:
            used[x] += times
    assert dict(used) == counts


def test_two_replace_the_smallest():
    # greedy alone gives 6+3 and 4+... ; 4+... fills the gap of 10-6 exactly
    plan = P.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1) and plan[1] == ([3], 1)


def check(out, rows, tokenizer, capacity):
    pieces = defaultdict(list)
    for r in out:
        pieces[r["sequence_id"]].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    expect = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        starts = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise([*starts, n])):
            expect.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(expect, key=key)
    total = sum(x[3] for x in expect)
    assert len(pieces) <= 1.05 * total / capacity + 2


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack_places_every_token(spark, tokenizer, capacity):
    check(P.pack(docs(spark).repartition(5), capacity=capacity).collect(), doc_rows(), tokenizer, capacity)


def test_ids_come_along(spark):
    out = P.pack(docs(spark), capacity=64, with_ids=True).collect()
    for r in out:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_empty_table(spark):
    assert P.pack(empty(spark)).collect() == []


def item_wise(items, capacity):
    """Best-two-fit item by item, every pair tried: sequences as sorted lengths."""
    left, out = sorted(items, reverse=True), []
    while left:
        own, gap = [], capacity
        while (fit := next((x for x in left if x <= gap), None)) is not None:
            left.remove(fit)
            own.append(fit)
            gap -= fit
        while gap and len(own) > 1:
            small = min(own)
            pairs = [(-(a + b), min(a, b), max(a, b)) for i, a in enumerate(left) for b in left[i + 1:] if small < a + b <= gap + small]
            if not pairs:
                break
            _, a, b = min(pairs)
            own.remove(small)
            left.remove(a)
            left.remove(b)
            left = sorted([*left, small], reverse=True)
            own += [a, b]
            gap += small - a - b
        out.append(tuple(sorted(own, reverse=True)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.sampled_from([40, 55, 64]))
def test_plan_equals_best_two_fit_item_by_item(items, capacity):
    counts = {x: items.count(x) for x in set(items)}
    got = sorted(tuple(sorted(p, reverse=True)) for p, times in P.best_two_fit(counts, capacity) for _ in range(times))
    assert got == item_wise(items, capacity)
