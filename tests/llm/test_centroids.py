import hashlib
import math
import random

import numpy as np
import pytest

from leadloom.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string, distance double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], SCHEMA)


def brute(rows, k=8, rounds=10):
    f32 = lambda c: float(np.float32(c))                          # noqa: E731
    kept = [(i, [math.floor(1024 * f32(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()      # noqa: E731
    cs = [list(x) for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for n in range(len(cs)):
            mine = [x for (_, x), o in zip(kept, of, strict=True) if o == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    end = [(i, *near(x)[::-1]) for i, x in kept]
    sums = [sum(d for _, n, d in end if n == c) for c in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, n, d, sums[n], sum(sums), sha[n]) for i, n, d in end), key=str)


def sample(seed, n):
    r = random.Random(seed)
    mids = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(mids)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * 63), (n + 3, [None] + [0.1] * 63), (n + 4, [float("nan")] + [0.1] * 63),
             (n + 5, [float("-inf")] + [0.1] * 63), (None, [0.25] * 64), (n + 6, [0.0] * 64), (n + 6, [0.0] * 64), (n + 7, [-0.3] * 64)]
    return rows + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = sample(seed, 200)
    got = C.report(vectors(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(i, n, d, s, t, h) for i, n, d, s, t, h in brute(rows)]


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(20)]
    assert sorted(tuple(r) for r in C.report(vectors(spark, rows)).collect()) == sorted(brute(rows))
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert sorted(tuple(r) for r in C.report(vectors(spark, rows)).collect()) == sorted(brute(rows))
    assert C.report(vectors(spark, [])).collect() == [] and C.report(vectors(spark, [(1, None)])).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="fit a long"):
        C.report(vectors(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])).collect()


def test_bound_filters_and_never_lies():
    r = np.random.default_rng(4)
    x = (r.normal(size=(3000, 64)) * r.gamma(1, 300, size=64)).astype(np.int64) + 5000
    c = x[:8].copy()
    mean, cov = x.mean(0), np.cov(x.T, bias=True)
    axis = C.axes(cov)
    y, rest = C.project(x, mean, axis)
    cy, crest = C.project(c, mean, axis)
    exact = ((x[:, None] - c) ** 2).sum(2)
    low = ((y[:, None] - cy) ** 2).sum(2) + (rest[:, None] - crest) ** 2
    assert (low <= exact * (1 + 1e-9) + 1).all()
    number, d, measured = C.nearest(x, y, rest, c, cy, crest)
    assert (number == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert measured < 0.5 * exact.size                            # the bound saves more than half of the distances
