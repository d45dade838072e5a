import hashlib
import random
import re

import pytest
from llm_data import docs, empty

from leadloom.llm import decontam as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        x = words(t)
        grams = [x] if 0 < len(x) < window else [x[i:i + window] for i in range(len(x) - window + 1)]
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def data(seed):
    r = random.Random(seed)
    few = ["the", "a", "of", "é1", "to", "in"]
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items = [x for x in items if len(x[1].split()) > 4 or x[0] < 2]
    items += [(2, items[0][1].upper() + "!"), (None, "x y z the of " * 3), (50, None), (51, "..."), (10, "the of a " * 5), (10, "the of a " * 5)]
    texts = [" ".join(r.choice(few + ["zz"]) for _ in range(r.randint(0, 80))) for _ in range(40)]
    texts += [f"Start, {items[3][1].title()}. {items[-1][1]} end " + texts[0], None, "", "?!", items[3][1] * 30]
    return items, texts


@pytest.mark.parametrize("seed", range(4))
def test_matcher_equals_brute_force(seed):
    items, texts = data(seed)
    m = D.Matcher([("" if n is None else str(n), D.words_of((t or "").encode())) for n, t in items], D.WINDOW)
    for t in texts:
        hit, found = m.of(D.words_of((t or "").encode()))
        b = brute(t, items)
        assert (int(hit.sum()), len(found)) == b[1:3]


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 30])
def test_report_equals_brute_force_in_one_or_many_blocks(spark, block_words, monkeypatch):
    items, texts = data(9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s", 1), rows[3]]
    monkeypatch.setattr(D.mark, "__defaults__", (D.WINDOW, block_words))
    got = sorted(map(tuple, D.report(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted([(r[0], *brute(r[1], items)) for r in rows], key=str)


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Clean text. {item.title()}, and more clean text that is long enough to stay here for good", "en", "s", 0),
            (2, item, "en", "s", 0), (3, "untouched\n text", "en", "s", 15), (4, None, None, None, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in D.decontaminate(docs(spark, rows), bench).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1]["text"] == "Clean text. , and more clean text that is long enough to stay here for good"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "untouched\n text" and out[4]["text"] is None
    assert out[1]["key"] == "k" and out[1]["_key"] == "_k"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(empty(spark), none).collect() == []
    assert [r["n_hit"] for r in D.report(docs(spark, [(1, "a b c", None, None, None)]), none).collect()] == [0]


def test_long_items_are_cut_and_blocks_are_written_in_chains(spark, monkeypatch):
    """A benchmark of many blocks and items longer than a block: every window is
    found, blocks keep their bound, and marks pass through written tables."""
    r = random.Random(3)
    few = ["the", "a", "of", "to", "in", "is", "it"]
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([2, 10, 95, 400])))) for i in range(14)]
    texts = [" ".join(r.choice(few) for _ in range(60)) for _ in range(30)] + ["zz " + items[3][1], None, ""]
    extra = [(i, t, "x", "lang") for i, t in items]
    bench = spark.createDataFrame(extra, "item_id long, text string, doc_id string, n_words string").repartition(3)
    sizes = [[len(w) for _, w in b] for b in D.item_blocks(D.item_pieces(bench, D.WINDOW, 40), 40)]
    assert len(sizes) > D.CHAIN + 2 and all(sum(x) <= 40 for x in sizes) and max(map(max, sizes)) == 40
    monkeypatch.setattr(D.mark, "__defaults__", (D.WINDOW, 40))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    got = sorted(map(tuple, D.report(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted([(x[0], *brute(x[1], items)) for x in rows], key=str)


def test_pieces_of_a_long_item_hold_each_window_once(spark):
    n = 1003
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n))), (2, "short one"), (3, None), (4, "--")], "item_id long, text string")
    pieces = [r["words"].decode().split() for r in D.item_pieces(bench, 10, 50).collect() if r["name"] == "1"]
    windows = [tuple(p[i:i + 10]) for p in pieces for i in range(len(p) - 9)]
    assert max(map(len, pieces)) == 50 and len(windows) == len(set(windows)) == n - 9
