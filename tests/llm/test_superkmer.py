import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import doc_rows, docs, empty, prose

from leadloom.llm import superkmer as S


def brute(rows, window):
    texts = [(r[1] or "").encode().split() for r in rows]
    c = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, texts):
        off = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if c[tuple(w[i:i + window])] > 1:
                off[i:i + window] = True
        kept = [x for x, o in zip(w, off) if not o]
        out.append((r[0], len(w), int(off.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def sort(x):
    return sorted(map(tuple, x), key=str)


def test_super_kmers_cover_every_window_once_and_agree_on_equal_windows():
    r = random.Random(3)
    h = np.array([r.choice([5, 6, 7, 8]) for _ in range(400)], dtype=np.uint64)
    seen = {}
    m, first, n = S.super_kmers(h, 12, 4)
    assert [i for f, k in zip(first, n) for i in range(f, f + k)] == list(range(len(h) - 11))
    for x, f, k in zip(m, first, n):
        for i in range(f, f + k):
            assert seen.setdefault(h[i:i + 12].tobytes(), x) == x


def test_report_equals_brute_force(spark):
    rows = doc_rows()
    assert sort(S.report(docs(spark).repartition(4)).collect()) == sort(brute(rows, 35))


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_minimisers_are_split(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT_VARIANTS", hot)
    rows = doc_rows(8, 40)
    assert sort(S.report(docs(spark, rows)).collect()) == sort(brute(rows, 35))


def test_edges_of_a_hot_passage_do_not_meet_in_one_task(spark, monkeypatch):
    """120 documents share a passage between words of their own: the windows at
    its edges are equal, the strings that hold them are not."""
    r = random.Random(6)
    passage = prose(r, 60)
    rows = [(i, f"{prose(r, 50)} {passage} {prose(r, 50)}", "en", "a", 1) for i in range(120)]
    count = S.count_windows

    def guarded(packed, weight, window):
        most = Counter(tuple(p.split(b" ")[:window]) for p in packed).most_common(1)[0][1]
        assert most < 60, f"{most} strings of one window in a task"
        return count(packed, weight, window)

    monkeypatch.setattr(S, "HOT_VARIANTS", 20)
    monkeypatch.setattr(S, "count_windows", guarded)
    assert sort(S.report(docs(spark, rows)).collect()) == sort(brute(rows, 35))


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "rolling", lambda h, w: np.zeros(len(h) - w + 1, dtype=np.uint64))
    got = S.count_windows([b"a b c d", b"x b c d", b"b c d"], np.array([1, 1, 1]), 3)
    assert [x.tolist() for x in got] == [[False, True], [False, True], [True]]


def test_cut_keeps_rows_columns_and_spacing(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"First,  line\n{passage}\n last one", "en", "a", 0), (2, f"{passage} tail", "en", "a", 0),
            (3, "alone \n here", "fr", "b", 12), (4, None, None, None, None)]
    out = {r["doc_id"]: r for r in S.cut(docs(spark, rows)).collect()}
    assert out[1]["text"] == "First,  line\n\n last one" and out[2]["text"] == " tail"
    assert out[3]["text"] == "alone \n here" and out[4]["text"] is None
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[1]["key"] == "k" and out[3]["_key"] == "_k"


def test_empty_table(spark):
    assert S.report(empty(spark)).collect() == []
