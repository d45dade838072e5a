"""Centroid clustering with PCA-rotated filtering (operator 13).

Vectors are whole numbers (``floor(scale * x)``). They are rotated once into the
principal axes of all vectors; what is stored beside a vector are its ``LEADING``
first rotated coordinates and the norm of the rest (``rotated``). For a vector x
and a centroid c

    |x - c|^2 >= |y_x - y_c|^2 + (r_x - r_c)^2

with y the leading coordinates and r the residual norms, for any orthonormal
axes. In a round the centroid of the least bound is measured first; only
centroids whose bound is not above that distance are measured too. Every
distance that decides is computed in integers; the bound gets a slack far
above its rounding error, so filtering never changes a result. Ties go to the
smaller centroid number.

Scale: the integer vectors and their rotated coordinates are written once. The
driver holds the centroids (``k`` vectors) and the axes; each round is one scan
without a shuffle of vectors: a task reduces its part to one sum per centroid
and dimension, which Spark adds up. Task memory is one Arrow batch.

Edge cases: vectors of another length and vectors with null, infinite or NaN
entries, and null vectors are left out; an empty table, or one without such
vectors, gives an empty result; fewer vectors than ``k`` give fewer centroids;
a null vec_id is hashed as empty text; equal hashes (repeated rows) are
ordered by the vector; repeated rows are vectors of their own; empty clusters
keep their centroid; a table of equal vectors works (all axes are zero
variance). Other columns are ignored. Components must be below 2^27 after
scaling, so that squared distances of 64 dimensions fit a long: beyond that the
job fails with an ``OverflowError`` instead of returning wrong distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

DIMS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
LEADING = 16
SEED = 3
LIMIT = 1 << 27


def usable(v: Column, dims: int) -> Column:
    """True for vectors of ``dims`` finite entries (never null)."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dims) & ~bad, F.lit(False))


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the kept vectors as arrays of longs."""
    v = F.col("embedding").cast("array<double>")
    # a double beyond the longs stops at their ends and is reported by ``block``
    return vectors.select("vec_id", v.alias("v")).where(usable(F.col("v"), dims)).select(
        "vec_id", F.transform("v", lambda c: F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), c * scale)))).alias("x"))


def block(batch: pa.RecordBatch, name: str = "x", dims: int = DIMS) -> np.ndarray:
    """An array column of equal lengths as an integer matrix."""
    x = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(x) and max(-int(x.min()), int(x.max())) >= LIMIT:
        raise OverflowError(f"components of {LIMIT} and more: squared distances may not fit a long")
    return x.astype(np.int64, copy=False)


def moments(ints: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, mean, and covariance: one row per task and pair of
    dimensions, added up by Spark."""
    upper = np.triu_indices(dims)

    def run(batches):
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = block(b, dims=dims).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            i = np.concatenate([[-1], np.full(dims, -1), upper[0]]).astype(np.int32)
            j = np.concatenate([[-1], np.arange(dims), upper[1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([[n], s, q[upper]]))], ["i", "j", "s"])

    got = ints.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    n, mean, cov = 0, np.zeros(dims), np.zeros((dims, dims))
    for r in got:
        if r["i"] >= 0:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"]
        elif r["j"] >= 0:
            mean[r["j"]] = r["s"]
        else:
            n = int(r["s"])
    mean = mean / max(n, 1)
    return n, mean, cov / max(n, 1) - np.outer(mean, mean)


def axes(cov: np.ndarray, leading: int = LEADING) -> np.ndarray:
    """The ``leading`` principal axes as columns. They steer how much is filtered,
    never a result."""
    return np.ascontiguousarray(np.linalg.eigh(cov)[1][:, ::-1][:, :leading])


def project(x: np.ndarray, mean: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    d = x - mean
    y = d @ axis
    return y, np.sqrt(np.maximum((d * d).sum(1) - (y * y).sum(1), 0))


def rotated(ints: DataFrame, mean: np.ndarray, axis: np.ndarray) -> DataFrame:
    """(vec_id, x, y, rest): leading coordinates and residual norm beside the
    vector."""
    dims, leading = axis.shape

    def run(batches):
        for b in batches:
            y, rest = project(block(b, dims=dims), mean, axis)
            at = pa.array(np.arange(0, len(rest) * leading + 1, leading, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(y.ravel())), pa.array(rest)],
                                             ["vec_id", "x", "y", "rest"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    return ints.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, x array<bigint>, y array<double>, rest double")


def nearest(x: np.ndarray, y: np.ndarray, rest: np.ndarray, c: np.ndarray, cy: np.ndarray, crest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and integer squared distance of each vector's nearest centroid,
    and how many distances were measured."""
    m, k = len(x), len(c)
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    low = (rest[:, None] - crest) ** 2
    for i in range(k):
        low[:, i] += ((y - cy[i]) ** 2).sum(1)
    first = low.argmin(1)
    d = np.full((m, k), np.iinfo(np.int64).max)
    rows = np.arange(m)
    best = d[rows, first] = ((x - c[first]) ** 2).sum(1)
    # the largest sum of squares that the bound was computed from, times far more than its rounding error
    scale = ((y * y).sum(1) + rest ** 2)[:, None] + ((cy * cy).sum(1) + crest ** 2)
    open_ = low - 1e-9 * scale - 1 <= best[:, None]
    open_[rows, first] = False
    measured = m
    for i in range(k):
        at = np.flatnonzero(open_[:, i])
        d[at, i] = ((x[at] - c[i]) ** 2).sum(1)
        measured += len(at)
    number = d.argmin(1)                                       # the first of equal ones
    return number, d[rows, number], measured


def _assigner(c: np.ndarray, mean: np.ndarray, axis: np.ndarray):
    cy, crest = project(c, mean, axis)
    dims, leading = axis.shape

    def assign(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = block(b, dims=dims)
        y = b.column(b.schema.get_field_index("y")).flatten().to_numpy(zero_copy_only=False).reshape(-1, leading)
        rest = b.column(b.schema.get_field_index("rest")).to_numpy(zero_copy_only=False)
        return (x, *nearest(x, y, rest, c, cy, crest)[:2])
    return assign


def updated(stored: DataFrame, c: np.ndarray, mean: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = c.shape
    assign = _assigner(c, mean, axis)

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, number, _ = assign(b)
            for i in range(k):
                of = x[number == i]
                sums[i] += of.sum(0)
                counts[i] += len(of)
        at = np.flatnonzero(counts)
        both = np.concatenate([counts[at, None], sums[at]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(at))),
                                          pa.array(both.ravel())], ["i", "j", "s"])

    got = stored.select("x", "y", "rest").mapInArrow(run, "i bigint, j bigint, s bigint").groupBy("i", "j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {(r["i"], r["j"]): int(r["s"]) for r in got}
    new = c.copy()
    for i in range(k):
        if total.get((i, 0), 0):
            new[i] = [total[i, j + 1] // total[i, 0] for j in range(dims)]
    return new


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``<seed>:<vec_id>``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = ints.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in got], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            leading: int = LEADING, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids."""
    ints = integers(vectors, dims, scale)
    kind = ints.schema["vec_id"].dataType.simpleString()
    c = first_centroids(ints, k, seed)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), c
    if max(-int(c.min()), int(c.max())) >= LIMIT:
        raise OverflowError(f"components of {LIMIT} and more: squared distances may not fit a long")
    _, mean, cov = moments(ints, dims)
    axis = axes(cov, leading)
    stored = stage(rotated(ints, mean, axis), "rotated")
    for _ in range(rounds):
        new = updated(stored, c, mean, axis)
        if (new == c).all():                                   # nothing moves any more
            break
        c = new
    assign = _assigner(c, mean, axis)

    def run(batches):
        for b in batches:
            _, number, d = assign(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), c


def report(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256."""
    out, c = cluster(vectors)
    spark = vectors.sparkSession
    out = stage(out, "clusters")                               # narrow rows, read for the sums and for the result
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [(i, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest(), sums.get(i, 0), sum(sums.values())) for i, x in enumerate(c)]
    # one row per centroid
    told = spark.createDataFrame(names, "cluster int, centroid_sha256 string, cluster_inertia bigint, inertia bigint")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
