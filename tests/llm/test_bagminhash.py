import random
from collections import Counter

import numpy as np
import pytest
from llm_data import docs, empty, prose

from leadloom.llm import bagminhash as B


def bag(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def likeness(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute_classes(rows):
    """doc position -> class id, by all pairs."""
    texts = [r[1] or "" for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or likeness(texts[i], texts[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], min((d for d in groups[find(i)] if d is not None), default=None)) for i, r in enumerate(rows)), key=str)


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "new" + str(r.random())[2:6]
    return " ".join(w)


def data():
    r = random.Random(4)
    rows, i = [], 0
    for size, edits in ((12, 1), (5, 3), (3, 8)):
        base = prose(r, 300)
        for _ in range(size):
            rows.append((i, edited(r, base, r.randint(0, edits)), "en", "s", 0))
            i += 1
    chain = prose(r, 400)                                # each like the one before it, the ends are not alike
    for _ in range(6):
        rows.append((i, chain, "en", "s", 0))
        chain, i = edited(r, chain, 6), i + 1
    rows += [(i + k, prose(r, r.randint(1, 300)), "en", "s", 0) for k in range(30)]
    star = prose(r, 200)                                 # copies like the centre, hardly like one another
    rows += [(500 + k, edited(r, star, 4), "en", "s", 0) for k in range(12)] + [(600, star, "en", "s", 0)]
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0), (702, " \n", "en", "s", 2), (703, "a b c", "en", "s", 5),
             (704, "A  b C", "en", "s", 6), (705, "a b", "en", "s", 3), (None, "a b c", "en", "s", 5), (706, "ab " * 300, "en", "s", 0),
             (707, "ab " * 310, "en", "s", 0), (708, "ab " * 100, "en", "s", 0), (709, prose(r, 30_000), "en", "s", 0)]
    rows += [rows[0], rows[20], rows[-1]]
    return rows


def test_signatures_estimate_weighted_jaccard():
    g = np.random.default_rng(2)
    h = np.unique(g.integers(0, 2 ** 63, 200).astype(np.uint64))
    wa = g.integers(1, 9, len(h))
    wb = np.maximum(1, wa - g.integers(0, 5, len(h)))
    a, b = (h, wa), (h[:150], wb[:150])
    true = np.minimum(wa[:150], wb[:150]).sum() / (np.maximum(wa[:150], wb[:150]).sum() + wa[150:].sum())
    s = B.signatures([a, b], 8000)
    assert abs((s[0] == s[1]).mean() - true) < 0.02
    assert abs(B.likeness(h, wa.astype(np.uint32), h[:150], wb[:150].astype(np.uint32)) - true) < 1e-12
    # alone or in a batch, in any order: the same signature
    assert (B.signatures([b, a], 8000)[1] == s[0]).all()


def test_classes_equal_all_pairs(spark):
    rows = data()
    got = sorted(((r["doc_id"], r["class_id"]) for r in B.classes(docs(spark, rows).repartition(3)).collect()), key=str)
    assert got == brute_classes(rows)


def test_keep_one_of_each_class(spark):
    rows = data()
    kept = B.keep_one(docs(spark, rows)).collect()
    classes = {c for _, c in brute_classes(rows)}
    assert sorted(r["doc_id"] for r in kept) == sorted(classes)
    assert kept[0]["key"] == "k" and set(kept[0].asDict()) == set(docs(spark, rows).columns)


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", f"s{i}") for i in range(30)] + [("q", "q2"), ("q2", "q")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in B.components(df).collect()}
    assert all(got[f"n{i:03}"] == "n000" for i in range(41))
    assert all(got[f"s{i}"] == "s0" for i in range(30)) and got["z"] == "s0" and got["q2"] == got["q"] == "q"


def test_empty_table(spark):
    assert B.classes(empty(spark)).collect() == [] and B.keep_one(empty(spark)).collect() == []


def test_parts_of_large_buckets_differ_between_bands(spark, monkeypatch):
    monkeypatch.setattr(B, "BUCKET_PART", 50)
    shared = spark.createDataFrame([(band, f"k{k:03}".encode(), 250) for band in range(25) for k in range(250)], "band long, key binary, size long")
    links = B.neighbour_links(shared)
    assert {bytes(r["root"]) for r in B.components(links).collect()} == {b"k000"}      # with the same parts in every band: five classes


def family(n=160, words=200, edits=3):
    """Variants of one text, most pairs somewhat below 0.8; some have a twin around 0.8."""
    r = random.Random(9)
    base = prose(r, words)
    rows = [(i, edited(r, base, edits), "en", "s", 0) for i in range(n)]
    return rows + [(1000 + i, edited(r, rows[i][1], 4), "en", "s", 0) for i in range(0, n, 4)]


@pytest.mark.parametrize("block", [10_000, 40_000, 4 << 20])
def test_families_around_the_threshold_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    monkeypatch.setattr(B, "BUCKET_PART", 8)
    rows = family()
    got = sorted(((r["doc_id"], r["class_id"]) for r in B.classes(docs(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows)
    assert len({c for _, c in got}) > 20


def test_alike_equals_likeness_on_multisets():
    r = np.random.default_rng(3)
    bags = []
    for _ in range(40):
        h = np.sort(r.choice(60, 50, replace=False)).astype(np.uint64)
        bags.append((h, r.integers(1, 4, 50).astype(np.uint32) if r.random() < 0.5 else None))
    sets = [B.elements(*b) for b in bags]
    n = len(bags)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if B.likeness(*bags[i], *bags[j]) >= 0.6}
    left = list(range(n))
    once = np.arange(n), np.ones(n, dtype=bool)
    got = B.alike(left, left, sets, np.arange(n), np.full((n, 2), 7), 7, 0.6, *once)
    assert set(got) == want and want and len(got) == len(want)
    assert B.alike(left, left, sets, np.arange(n), np.tile([3, 7], (n, 1)), 7, 0.6, *once) == []      # compared in band 3


def test_rows_grow_with_a_family_not_with_its_square(spark):
    """One bucket of n nodes, a fifth of them outside the largest component."""
    def rows(n):
        key = [f"k{i:05}".encode() for i in range(n)]
        opened = spark.createDataFrame([(1, k, b"major" if i % 5 else k, b"major") for i, k in enumerate(key)], "band long, key binary, root binary, major binary")
        bags = spark.createDataFrame([(k, b"8bytes.." * 20, None) for k in key], "key binary, h binary, w binary")
        return B.dealt(opened, bags).count()
    assert [rows(n) for n in (400, 800, 1600)] == [480, 960, 1920]
