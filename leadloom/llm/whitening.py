"""Embedding whitening through an exact characteristic polynomial (operator 12).

Entries become whole numbers, so the scatter matrix of the distinct vectors,
``n * sum(u u') - S S'``, is known exactly (``scatter``). Its characteristic
polynomial is computed modulo many primes (reduction to Hessenberg form, then
the recurrence of leading minors) and put together by Chinese remaindering
(``characteristic``). All roots of that polynomial are real, so the number of
roots above a point is exactly the number of sign changes of the polynomial
shifted there: bisection finds each eigenvalue, and its multiplicity, to 160
bits below the trace (``root``). The component is the null vector of the matrix
less its eigenvalue, by inverse iteration in 256-bit fixed point (``component``),
rounded to double at the end; an eigenvalue of multiplicity m gets an
orthonormal basis of its null space. The sign makes the largest entry positive.

Scale: Spark makes vectors distinct, adds up the scatter (one row per task and
pair of dimensions), shares out the primes and the components over tasks and
whitens all rows in one scan. The driver holds what one matrix of
``dims x dims`` holds, whatever the number of rows; task memory is one Arrow batch.

Edge cases: null vectors, empty vectors and vectors with null, infinite or NaN
entries are left out; of several lengths the one that most rows have counts
(of equally frequent ones the smallest) and other lengths are left out;
repeated vectors count once in the fit and are all whitened; null ids are kept.
Components of zero variance are not returned (one vector, or equal vectors:
no rows); an empty table gives an empty result; other columns are ignored. An
entry of 2^40 and more after scaling raises ``OverflowError``. A deviation that
does not fit a long (beyond some 10^7 distinct vectors) is exact in ``whiten`` and
null in the report.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SCALE = 64
COMPONENTS = 16
#: bits below the trace: to which roots are isolated, of the fixed point, and by
#: which inverse iteration stays beside the root, so that all directions of an
#: eigenvalue grow alike and well above rounding
ROOT_BITS, POINT, BESIDE = 160, 256, 130
LIMIT = 1 << 40


# ---------------------------------------------------------------- whole numbers

def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, u): ``floor(scale * entry)`` of the kept vectors, all of one length.
    The contract's offset of 1,000,000 changes no difference and is left out."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", v.alias("v")).where(usable(F.col("v")))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    # a double beyond the longs stops at their ends and is reported by ``matrix``
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), c * scale))))
    return kept.where(F.size("v") == dims).select("vec_id", whole.alias("u"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("u"))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(x) and max(-int(x.min()), int(x.max())) >= LIMIT:
        raise OverflowError("an entry is 2^40 or more after scaling")
    return x.reshape(len(col), -1) if len(col) else x.reshape(0, 0)


def products(x: np.ndarray) -> np.ndarray:
    """x' x, exact: in doubles while every partial sum is a whole number that
    they hold, else in Python integers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) <= 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T.dot(o)


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S, and n * sum(u u') - S S' of all rows, exact."""
    def run(batches):
        n, s, q = 0, 0, 0
        for b in batches:
            x = matrix(b)
            if len(x):
                n, s, q = n + len(x), s + x.sum(0).astype(object), q + products(x)
        if n:
            d = len(s)
            i, j = np.triu_indices(d)
            rows = [-1] + [-1] * d + i.tolist(), [-1, *range(d)] + j.tolist(), [n, *s.tolist(), *q[i, j].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(map(str, rows[2]))],
                                             ["i", "j", "s"])

    got = fit.select("u").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    cells = {(r["i"], r["j"]): int(r["s"]) for r in got}
    n, d = cells.get((-1, -1), 0), sum(1 for i, j in cells if i < 0 <= j)
    s = [cells[-1, j] for j in range(d)]
    a = np.empty((d, d), dtype=object)
    for i in range(d):
        for j in range(i, d):
            a[i, j] = a[j, i] = n * cells[i, j] - s[i] * s[j]
    return n, s, a


# ------------------------------------------------- the characteristic polynomial

def is_prime(p: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.2e9."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    d, r = p - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        for _ in range(r - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31 whose product is above ``bound``, and one more."""
    out, product, p = [], 1, 1 << 31
    while product <= bound:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    while not is_prime(p := p - 1):
        pass
    return [*out, p]


def characteristic_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - a) modulo p, lowest power first."""
    h = (a % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            i = m + below[0]
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)                 # row k: the leading minor of size k
    poly[0, 0] = 1
    for k in range(1, d + 1):
        q = np.zeros(d + 1, np.int64)
        q[1:] = poly[k - 1, :-1]
        q = (q - int(h[k - 1, k - 1]) * poly[k - 1]) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            q = (q - int(h[k - i - 1, k - 1]) * chain % p * poly[k - i - 1]) % p
        poly[k] = q
    return poly[d].tolist()


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least absolute value with these residues."""
    value, product = None, 1
    for p, r in residues.items():
        if value is None:
            value = list(r)
        else:
            inv = pow(product, -1, p)
            value = [v + product * ((x - v) * inv % p) for v, x in zip(value, r, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(x I - a), lowest power first, of a symmetric matrix
    without negative eigenvalues: none exceeds (1 + trace / d)^d."""
    d = len(a)
    primes = primes_beyond(2 * (int(np.trace(a)) // d + 2) ** d)

    def run(batches):
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([characteristic_mod(a, p) for p in ps], pa.list_(pa.int64()))],
                                             ["p", "c"])

    todo = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(spark.sparkContext.defaultParallelism)
    got = {r["p"]: r["c"] for r in todo.mapInArrow(run, "p bigint, c array<bigint>").collect()}
    c = remaindered({p: got[p] for p in primes[:-1]})
    if any((v - r) % primes[-1] for v, r in zip(c, got[primes[-1]], strict=True)):
        raise ArithmeticError("the characteristic polynomial does not fit its control prime")
    return c


# ------------------------------------------------------------ roots, components

def roots_above(c: list[int], at: int) -> int:
    """Number of roots above ``at`` (a whole number, not negative), counted with
    multiplicity; exact since all roots are real."""
    if at:
        # p(at * y), then y + 1 for y by repeated sums; scaling changes no sign
        power, q = 1, []
        for v in c:
            q.append(v * power)
            power *= at
        s = np.array(q, dtype=object)
        for i in range(len(s) - 1):
            s[i:] = np.add.accumulate(s[i:][::-1])[::-1]
        c = s.tolist()
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def root(c: list[int], trace: int, k: int) -> tuple[int, int, int, int] | None:
    """The k-th largest root in units of 2^-shift: (value, shift, multiplicity,
    place among its equals); None where it is not positive."""
    if roots_above(c, 0) < k:
        return None
    shift = max(0, ROOT_BITS - trace.bit_length())
    d = len(c) - 1
    fine = [v << shift * (d - i) for i, v in enumerate(c)]
    lo, hi = 0, (trace << shift) + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if roots_above(fine, mid) >= k:
            lo = mid
        else:
            hi = mid
    above = roots_above(fine, hi)
    return hi, shift, roots_above(fine, lo) - above, k - above


def _dot(x: np.ndarray, y: np.ndarray) -> int:
    return int((x * y).sum()) >> POINT


def orthonormal(block: list[np.ndarray]) -> list[np.ndarray]:
    """Gram-Schmidt in fixed point."""
    out: list[np.ndarray] = []
    for v in block:
        v = v * (1 << POINT) // max(1, max(abs(x) for x in v))
        for _ in range(2):
            for w in out:
                v = v - (w * _dot(v, w) >> POINT)
            v = (v << POINT) // max(1, isqrt(int((v * v).sum())))
        out.append(v)
    return out


def solve(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """m^-1 rhs in fixed point, rows pivoted."""
    m, d = np.concatenate([m, rhs], axis=1), len(m)
    for k in range(d):
        i = k + max(range(d - k), key=lambda j: abs(m[k + j, k]))
        if i != k:
            m[[k, i]] = m[[i, k]]
        pivot = m[k, k]
        f = (m[k + 1:, k] << POINT) // pivot
        m[k + 1:, k:] -= f[:, None] * m[k, k:] >> POINT
    x = np.empty((d, rhs.shape[1]), dtype=object)
    for k in range(d - 1, -1, -1):
        rest = m[k, d:] - ((m[k, k + 1:d, None] * x[k + 1:]).sum(0) >> POINT if k < d - 1 else 0)
        x[k] = (rest << POINT) // m[k, k]
    return x


def component(a: np.ndarray, trace: int, value: int, shift: int, multiplicity: int, place: int) -> np.ndarray:
    """The unit eigenvector of the eigenvalue ``value / 2^shift``; of several
    equal ones the ``place``-th of an orthonormal basis."""
    d, bits = len(a), trace.bit_length()
    unit = (a << POINT) >> bits                                # entries at most 1
    eye = np.zeros((d, d), dtype=object)
    np.fill_diagonal(eye, ((value << POINT) >> (bits + shift)) + (1 << POINT - BESIDE))
    start = np.random.default_rng(12).integers(1, 1 << 62, (d, multiplicity)).astype(object)
    block = orthonormal([start[:, i] for i in range(multiplicity)])
    for _ in range(3):
        got = solve(unit - eye, np.stack(block, axis=1))
        block = orthonormal([got[:, i] for i in range(multiplicity)])
    v = np.array([x / (1 << POINT) for x in block[place - 1]])
    v /= np.sqrt((v * v).sum())
    return v if v[np.abs(v).argmax()] > 0 else -v


# ------------------------------------------------------------------- the model

@dataclass
class Whitening:
    """n and sums of the fit list, eigenvalues (falling), components as columns,
    each component's share of the trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n as doubles, and the exact sums of (n x - S)^2."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        exact = object if len(self.sums) * top * top >= 1 << 63 else np.int64
        d = x.astype(exact) * self.n - np.array(self.sums, dtype=exact)
        return d.astype(np.float64) / self.n, (d * d).sum(1).tolist()

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.axes / np.sqrt(self.values))


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of a frame of distinct vectors; None where nothing varies."""
    spark = fit.sparkSession
    n, sums, a = scatter(fit)
    if not n or not any(a.ravel()):
        return None
    g = gcd(*a.ravel().tolist())
    a = a // g
    trace = int(np.trace(a))
    c = characteristic(spark, a)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                found = root(c, trace, k)
                if found:
                    v = component(a, trace, *found)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([str(found[0])]), pa.array([found[1]]), pa.array([v.tolist()])],
                                                     ["k", "value", "shift", "v"])

    ks = [(k,) for k in range(1, min(components, len(a)) + 1)]
    todo = spark.createDataFrame(ks, "k bigint").repartition(len(ks))
    got = sorted(todo.mapInArrow(run, "k bigint, value string, shift bigint, v array<double>").collect())
    # of A / g in units of 2^-shift; the covariance is A / n^2
    values = np.array([int(r["value"]) * g / ((n * n) << r["shift"]) for r in got])
    shares = np.array([int(r["value"]) / (trace << r["shift"]) for r in got])
    return Whitening(n, sums, values, np.array([r["v"] for r in got]).T, shares)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the
    identity."""
    k = len(model.values)

    def run(batches):
        s, q = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = model.project(model.centred(matrix(b))[0])
                s, q = s + w.sum(0), q + w.T @ w
        cells = np.concatenate([s, q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int64)), pa.array(cells)], ["i", "s"])

    got = {r["i"]: r["s"] for r in fit.select("u").mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    cells = np.array([got[i] for i in range(k + k * k)]) / model.n
    return float(np.abs(cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k]) - np.eye(k)).max())


def whiten(ints: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w): the exact deviation and the whitened vector."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, deviation = model.centred(matrix(b))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(str, deviation)), pa.array(list(model.project(x)))],
                                                 ["vec_id", "deviation", "w"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    out = ints.select("vec_id", "u").mapInArrow(run, f"vec_id {kind}, deviation string, w array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def report(vectors: DataFrame) -> DataFrame:
    """Per kept row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    ints = stage(integers(vectors), "integers")
    fit = stage(ints.select("u").distinct(), "fit")
    model = fit_whitening(fit)
    if model is None:
        kind = ints.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
                                                        "explained double, identity_error double")
    error = identity_error(fit, model)
    long = F.expr("try_cast(deviation AS BIGINT)")
    rows = whiten(ints, model).select("vec_id", long.alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("at"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(error).alias("identity_error"))
