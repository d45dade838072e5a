import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_data import doc_rows, docs, empty

from leadloom.llm import suffixtree as S


def toks(t):
    return (t or "").encode().lower().split() + [b""]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Brute:
    """The tree by dictionaries over all training texts at once."""

    def __init__(self, rows, p_min, depth, divergence, gamma=S.GAMMA):
        train = [toks(r[1]) for r in rows if not held(r[0])]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v, self.depth = sum(self.c.values()), len(self.c), depth
        least = max(2.0, p_min * self.n)
        grams = defaultdict(Counter)
        for t in train:
            for i in range(len(t)):
                for d in range(1, depth + 1):
                    if i >= d:
                        grams[tuple(t[i - d:i])][t[i]] += 1
        self.nodes, candidates = {}, set()
        for d in range(1, depth + 1):
            for ctx, nxt in grams.items():
                total = sum(nxt.values())
                if len(ctx) != d or total < least or (d > 1 and (ctx[1:] not in self.nodes or ctx[:-1] not in candidates)):
                    continue
                candidates.add(ctx)
                kept = {s: n for s, n in nxt.items() if n > 1 and n >= gamma * total}
                if not kept:
                    continue
                escape = 1 - sum(n - S.DISCOUNT for n in kept.values()) / total
                above = {s: self.prob(s, ctx[1:]) for s in kept}
                p = {s: (n - S.DISCOUNT) / total + escape * above[s] for s, n in kept.items()}
                kl = sum(x * math.log(x / above[s]) for s, x in p.items()) + (1 - sum(p.values())) * math.log(escape)
                if kl >= divergence:
                    self.nodes[ctx] = (escape, p)

    def root(self, s):
        return (self.c[s] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def prob(self, s, ctx):
        if not ctx:
            return self.root(s)
        escape, p = self.nodes[ctx]
        return p[s] if s in p else escape * self.prob(s, ctx[1:])

    def of(self, t):
        out = 0.0
        for i, s in enumerate(t):
            d = 0
            while d < min(self.depth, i) and tuple(t[i - d - 1:i]) in self.nodes:
                d += 1
            out += math.log10(self.prob(s, tuple(t[i - d:i])))
        return out


def rows_of_language():
    r = random.Random(2)
    follow = {w: [r.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    rows = []
    for i in range(150):
        w = r.choice("abcdefgh")
        t = []
        for _ in range(r.randint(1, 80)):
            t.append(w if r.random() < 0.9 else "rare" + str(r.randrange(60)))
            w = r.choice(follow[w])
        rows.append((i, " ".join(t).title(), "en", "s", 1))
    return rows + doc_rows()[-12:]


@pytest.mark.parametrize(("depth", "block", "gamma"), [(1, 1 << 20, 0.001), (2, 2000, 0.05), (3, 500, 0.001)])
def test_scores_equal_brute_force(spark, depth, block, gamma):
    rows = rows_of_language()
    least = 0.05 if depth < 3 else 0.001
    b = Brute(rows, 0.005, depth, least, gamma)
    assert len({len(c) for c in b.nodes}) == depth       # contexts of every length
    got = S.score(docs(spark, rows).repartition(3), ~S.held_out(), 0.005, depth, block, least, gamma).collect()
    want = []
    for r in rows:
        t = toks(r[1])
        want.append((r[0], held(r[0]), len(t), sum(b.c[w] > 0 for w in t), b.n, round(sum(math.log10(b.root(w)) for w in t), 6), round(b.of(t), 6)))
    have = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_probabilities_sum_to_one():
    b = Brute(rows_of_language(), 0.005, 2, 0.05)
    for ctx in list(b.nodes)[:20]:
        total = sum(b.prob(s, ctx) for s in b.c) + b.prob(b"never", ctx)   # all unseen symbols share one slot of the root
        assert abs(total - 1) < 1e-9


def test_held_out_texts_gain_from_contexts(spark):
    got = [r for r in S.score(docs(spark, rows_of_language()), ~S.held_out(), 0.005).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_no_training_rows_and_empty_table(spark):
    from pyspark.sql import functions as F
    got = S.score(docs(spark, [(1, "a b", None, None, None), (2, None, None, None, None)]), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert S.score(empty(spark), ~S.held_out()).collect() == []


def test_contexts_and_symbols_need_no_share_of_the_corpus(spark):
    """Contexts seen 20 times and symbols seen a few times count beside much
    other text, and contexts are as long as they tell more."""
    r = random.Random(5)
    rows = [(i, "of " + " of ".join(r.choice("abcdefgh") for _ in range(60)), "en", "s", 1) for i in range(160)]
    rows += [(200 + i, "of seldom", "en", "s", 1) for i in range(6)]
    says = [("big", "cat", "one"), ("big", "dog", "two"), ("low", "cat", "three"), ("low", "dog", "four")]
    rows += [(300 + 10 * i + k, " ".join(says[k][:2]) + " in " + says[k][2], "en", "s", 1) for i in range(26) for k in range(4)]
    rows += [(1000 + i, "filler " * 4000, "en", "s", 1) for i in range(80)]
    shared = Brute(rows, 1e-4, 2, S.DIVERGENCE, 1e-3)
    b = Brute(rows, S.MIN_COUNT / shared.n, 5, S.DIVERGENCE, 0)
    assert b"seldom" not in shared.nodes[b"of",][1] and b"seldom" in b.nodes[b"of",][1]
    assert (b"big", b"cat", b"in") in b.nodes and (b"big", b"cat") not in shared.nodes and max(map(len, b.nodes)) == 3
    for row in S.score(docs(spark, rows).repartition(3), ~S.held_out()).collect():
        want = b.of(toks(dict((x[0], x[1]) for x in rows)[row["doc_id"]]))
        assert abs(row["score"] - want) < 1e-6


@pytest.mark.parametrize("hot", [1, 40, 400])
def test_contexts_over_several_buckets_equal_brute_force(spark, hot):
    """Contexts of many occurrences are dealt by their symbols; blocks and
    buckets are small, so that every context meets both."""
    rows = rows_of_language()
    b = Brute(rows, 0.001, 3, 0.001, 0.001)
    got = S.score(docs(spark, rows).repartition(3), ~S.held_out(), 0.001, 3, 1500, 0.001, 0.001, 0, 700, hot).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(b.of(toks(r[1])), 6) for r in rows)


def test_pairs_are_written_packed(spark, monkeypatch):
    """No row for each pair or word of a block; all that is written at any depth
    stays below 4 times the texts."""
    import os
    from urllib.parse import urlparse
    r = random.Random(9)
    words = ["w%x" % (r.getrandbits(30)) for _ in range(600)]
    rows = [(i, " ".join(r.choice(words) for _ in range(400)), "en", "s", 1) for i in range(400)]
    written, stage = [], S.stage

    def measured(df, label):
        out = stage(df, label)
        written.append((label, out.count(), sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(S, "stage", measured)
    got = S.score(docs(spark, rows).repartition(2), ~S.held_out()).count()
    assert got == 400 and len(written) >= 3
    assert max(n for _, n, _ in written) < 2000
    assert sum(size for _, _, size in written) < 4 * sum(len(x[1]) for x in rows)


@pytest.mark.parametrize("carry", [1, 2, 3])
def test_what_is_carried_equals_walking_the_texts(spark, monkeypatch, carry):
    """Texts are walked for the first depths only; deeper contexts grow from the
    rest that blocks carry, in the same order and to the same scores."""
    rows = rows_of_language()
    says = ["low tide at the old sea wall by noon", "tide at the old sea wall by dusk", "the old sea wall by dawn"]
    rows += [(400 + i, says[i % 3] + " " + says[i // 3 % 3], "en", "s", 1) for i in range(200)] + [(700 + i, "sea wall", "en", "s", 1) for i in range(40)]
    b = Brute(rows, S.MIN_COUNT / 1e5, 12, 0.01)
    b = Brute(rows, S.MIN_COUNT / b.n, 12, 0.01, 0)
    deepest = max(map(len, b.nodes))
    assert 4 <= deepest < 12
    walked, grams = [], S._grams
    monkeypatch.setattr(S, "CARRY", carry)
    monkeypatch.setattr(S, "_grams", lambda d, *a: walked.append(d) or grams(d, *a))
    got = S.score(docs(spark, rows).repartition(3), ~S.held_out(), 0.0, None, 1500, 0.01, 0.0, S.MIN_COUNT, 700, 400).collect()
    assert walked == list(range(1, carry + 1))
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(b.of(toks(r[1])), 6) for r in rows)


def test_packed_numbers_and_words():
    import numpy as np
    import pyarrow as pa
    for x in (np.arange(0), np.zeros(5, dtype=np.int64), np.array([1, 255, 256, 1 << 40, -1]), np.array([0.1, np.nan, -3.5]), np.array([1 << 63], dtype=np.uint64)):
        assert S.unpack(S.pack(x), x.dtype).tobytes() == x.tobytes()
    r = random.Random(3)
    texts = ["".join(chr(r.randrange(160)) for _ in range(r.randrange(90))) for _ in range(500)] + [None, "", " ", " a  b\u00a0c\u2003\x1f "]
    want = [(t or "").encode().lower().split() for t in texts]
    lens, flat = S.split_words(pa.array(texts))
    assert lens.tolist() == list(map(len, want)) and [w.encode() for w in flat.to_pylist()] == [w for t in want for w in t]
