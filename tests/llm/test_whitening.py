import math
import random
from fractions import Fraction

import numpy as np
import pytest

from leadloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, u string, w int, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "u", 2, 3) for i, v in rows], SCHEMA)


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def faddeev(a):
    """Characteristic polynomial by Faddeev-LeVerrier in fractions."""
    d = len(a)
    c, m = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) / k
    return [int(x) for x in c]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_characteristic_polynomial(spark, d):
    g = np.random.default_rng(d)
    for rank in {1, d}:
        x = g.integers(-10 ** 6, 10 ** 6, (rank, d)).astype(object)
        a = x.T.dot(x) * 10 ** 12
        assert W.characteristic(spark, a) == faddeev(a.tolist())


def test_modular_polynomial_with_pivots():
    g = np.random.default_rng(3)
    for _ in range(30):
        a = g.integers(-1, 2, (6, 6)).astype(object)               # many zero pivots
        assert W.characteristic_mod(a, 101) == [v % 101 for v in faddeev(a.tolist())]


def test_roots_and_multiplicities():
    c = [1]
    for r in (7, 7, 3, 3, 3, 1, 0):
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    assert [W.roots_above(c, at) for at in (0, 1, 2, 3, 6, 7)] == [6, 5, 5, 2, 2, 0]
    got = [W.root(c, 24, k) for k in range(1, 8)]
    assert [(v / 2 ** s, m, p) for v, s, m, p in got[:6]] == [(7, 2, 1), (7, 2, 2), (3, 3, 1), (3, 3, 2), (3, 3, 3), (1, 1, 1)]
    assert got[6] is None


def test_components_of_close_and_equal_eigenvalues():
    q = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, 1, -1], [1, -1, -1, 1]], dtype=object)      # orthogonal, length 2
    for values in ([10 ** 25, 10 ** 25 + 1, 5, 5], [9, 9, 9, 2], [4, 3, 2, 1]):
        a = q.T.dot(np.diag(np.array(values, dtype=object))).dot(q)
        trace = int(np.trace(a))
        c = faddeev(a.tolist())
        got = []
        for k in range(1, 5):
            value, shift, multiplicity, place = W.root(c, trace, k)
            got.append(W.component(a, trace, value, shift, multiplicity, place))
        v = np.array(got)
        assert np.abs(v @ v.T - np.eye(4)).max() < 1e-14
        order = sorted(range(4), key=lambda i: -values[i])
        for k, i in enumerate(order):                            # inside the space of its value
            same = [j for j in range(4) if values[j] == values[i]]
            assert abs(sum((v[k] @ (q[j].astype(float) / 2)) ** 2 for j in same) - 1) < 1e-13


def brute(rows, d):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)] for x in fit])
    e, v = np.linalg.eigh(z.T @ z / n)
    return kept, n, s, e[::-1], v[:, ::-1]


def sample(seed, n, d):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.1 * (j + 1)) for j in range(d)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * (d - 1)), (n + 3, [None] + [0.1] * (d - 1)), (n + 4, [float("nan")] * d),
             (n + 5, [float("inf")] + [0.1] * (d - 1)), (None, [0.25] * d)]
    return rows + rows[:20] + rows[:1] * 30


@pytest.mark.parametrize("d", [5, 24])
def test_equals_numpy(spark, d):
    rows = sample(d, 400, d)
    got = W.report(vectors(spark, rows).repartition(4)).collect()
    kept, n, s, e, v = brute(rows, d)
    k = min(16, d)
    assert len(got) == len(kept) * k
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for i, x in kept:
        mine = by[i]
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        for r in mine:
            c = r["component"] - 1
            assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            assert abs(r["whitened"]) == pytest.approx(abs(centred @ v[:, c]) / math.sqrt(e[c]), rel=1e-6, abs=1e-8)
            assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)


def test_equal_directions_few_rows_and_none(spark):
    cross = [(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, -1.0, 0.0])]      # two equal eigenvalues, one zero
    got = W.report(vectors(spark, cross)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, k) for i in range(4) for k in (1, 2)]
    assert all(r["explained"] == pytest.approx(0.5) and r["identity_error"] < 1e-12 for r in got)
    assert W.report(vectors(spark, [(1, [0.5] * 4), (2, [0.5] * 4)])).collect() == []
    assert W.report(vectors(spark, [])).collect() == [] and W.report(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert len(W.report(vectors(spark, [(1, [0.5] * 4), (2, [0.7] * 4)])).collect()) == 2


def test_large_entries(spark):
    rows = [(i, [float(random.Random(i).randrange(1 << 30)), 1.0 * i]) for i in range(60)]
    kept, n, s, e, _ = brute(rows, 2)
    got = W.report(vectors(spark, rows)).collect()
    assert {r["identity_error"] < 1e-9 for r in got} == {True}
    x = dict(kept)
    for r in got:
        want = sum((n * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s, strict=True))
        assert r["deviation"] == (want if want < 1 << 63 else None)
    with pytest.raises(Exception, match="after scaling"):
        W.report(vectors(spark, [(1, [1e30, 1.0]), (2, [0.0, 1.0])])).collect()
