"""Quality classes by hierarchical empirical Bayes (operator 8).

Evidence: logistic regressions in numpy, one for quality and one for toxicity,
on the shape of a text (case, symbols, repetition, word length) and on the
presence of words whose rates differ between the classes. They are fitted on at
most about ``SAMPLE`` labelled documents, chosen by the hash of their id (the
documented bound of what the driver gathers) and applied to all whole texts.

Sites: a document has a host (``source``) and a path in it (its ``lang``
section). The probabilities of all documents are summed by path and by host.
The spread of host rates around the global rate, beyond what sampling explains,
gives the strength of the global prior (method of moments); the spread of path
rates around their hosts' gives that of the host prior. A sparse path shrinks
to its host and a sparse host to the global rate.

Posterior: the document's own log-odds plus the log-odds of its path's rate,
taken without the document itself, over the global rate.

Scale: texts are read once and never shuffled; narrow rows are aggregated with
map-side partial sums and joined back (a hot host is a join Spark can split);
hyperparameters are one row.

Edge cases: null and empty texts have no words and are not kept; null host or
path is the site ``''``; null labels are ignored, and of several labels for a
document the worse counts; without labels (or with one class only) the evidence
is the base rate (quality 1, toxicity 0 without any); repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_arrow, stage
from .decontam import words_of

SAMPLE = 8_000
HASHED = 1 << 20
MIN_DOCS, MIN_Z = 8, 4.0
SHAPES = 9
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
_SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]")
_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(shape of the whole text, sorted distinct hashed words)."""
    t = text or b""
    raw, words = t.split(), words_of(t)
    n, size = max(1, len(raw)), max(1, len(t))
    lines = t.splitlines()
    same = sum(a == b for a, b in zip(raw, raw[1:]))
    symbols, upper = len(_SYMBOLS.findall(t)), len(_UPPER.findall(t))
    shape = np.array([
        np.log1p(len(raw)), symbols / n, upper / size * 5, len(_DIGIT.findall(t)) / size * 5, 1 - len(set(words)) / max(1, len(words)),
        same / n * 3, size / n / 10, 1 - len(set(lines)) / max(1, len(lines)), t.count(b"|") / n * 3], dtype=np.float64)
    ids = {zlib.crc32(w) % HASHED for w in words}
    return shape, np.array(sorted(ids), dtype=np.int32)


class Evidence:
    """A logistic regression on shapes and selected words."""

    def __init__(self, base: float):
        self.base = base                 # used while there is nothing to learn from
        self.words = np.empty(0, dtype=np.int64)
        self.weight: np.ndarray | None = None

    def _matrix(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(rows), 1 + 2 * SHAPES + len(self.words)))
        x[:, 0] = 1
        for i, (shape, ids) in enumerate(rows):
            x[i, 1:1 + SHAPES] = np.minimum(shape, 10)
            x[i, 1 + SHAPES:1 + 2 * SHAPES] = np.minimum(shape, 10) ** 2 / 4
            if len(self.words) and len(ids):
                j = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
                x[i, 1 + 2 * SHAPES + j[self.words[j] == ids]] = 1
        return x

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> None:
        if not len(y):
            return
        self.base = float(y.mean())
        if self.base in (0.0, 1.0):
            return
        own = [np.zeros(HASHED, dtype=np.int32) for _ in range(2)]
        for (_, ids), c in zip(rows, y.astype(int)):
            own[c][ids] += 1
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        p, q = (own[1] + 0.5) / (n1 + 1), (own[0] + 0.5) / (n0 + 1)
        z = np.log(p / q) / np.sqrt(1 / (own[1] + 0.5) + 1 / (own[0] + 0.5))
        self.words = np.flatnonzero((own[0] + own[1] >= MIN_DOCS) & (np.abs(z) >= MIN_Z))
        if len(self.words) > 600:        # the strongest ones
            self.words = np.sort(self.words[np.argsort(-np.abs(z[self.words]), kind="stable")[:600]])
        x = self._matrix(rows)
        w = np.zeros(x.shape[1])
        w[0] = np.log(self.base / (1 - self.base))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):           # Newton
            s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (s - y) + penalty * w
            h = (x * (s * (1 - s))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weight = w

    def of(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(rows), self.base)
        return 1 / (1 + np.exp(-np.clip(self._matrix(rows) @ self.weight, -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Evidence, Evidence]:
    """(quality, toxicity) evidence from labelled documents."""
    own = (labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
           .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")))
    n = own.count()
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.select("doc_id", "text").join(own.where(chance < min(1.0, sample / max(1, n))), "doc_id").select("q", "t", "text")

    def run(batches):
        for b in batches:
            rows = [features(t) for t in binary_column(b, "text")]
            yield pa.RecordBatch.from_pydict({
                "q": b.column("q").cast(pa.int32()), "t": b.column("t").cast(pa.int32()),
                "shape": pa.array([s.tobytes() for s, _ in rows], pa.binary()),
                "ids": pa.array([i.tobytes() for _, i in rows], pa.binary())})

    got = sorted((bytes(r["shape"]), bytes(r["ids"]), r["q"], r["t"]) for r in
                 map_arrow(chosen, run, "q int, t int, shape binary, ids binary").collect())
    rows = [(np.frombuffer(s), np.frombuffer(i, dtype=np.int32)) for s, i, _, _ in got]
    quality, toxic = Evidence(1.0), Evidence(0.0)
    quality.fit(rows, np.array([float(g[2]) for g in got]))
    toxic.fit(rows, np.array([float(g[3]) for g in got]))
    return quality, toxic


def evidence(docs: DataFrame, quality: Evidence, toxic: Evidence, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, worded, q, t): the documents' own probabilities."""
    rows = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")

    def run(batches):
        for b in batches:
            texts = binary_column(b, "text")
            q, t, worded = np.empty(len(texts)), np.empty(len(texts)), np.empty(len(texts), dtype=bool)
            for lo in range(0, len(texts), 500):
                feats = [features(x) for x in texts[lo:lo + 500]]
                q[lo:lo + 500], t[lo:lo + 500] = quality.of(feats), toxic.of(feats)
                worded[lo:lo + 500] = [len(i) > 0 for _, i in feats]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "host": b.column("host"), "path": b.column("path"),
                                              "worded": pa.array(worded), "q": pa.array(q), "t": pa.array(t)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {id_type}, host string, path string, worded boolean, q double, t double")


def _strength(mean: float, spread: float | None, noise: float | None) -> float:
    """Pseudo-documents of a prior: the Beta strength whose variance is the
    spread of the rates beyond sampling noise."""
    tau = max((spread or 0.0) - (noise or 0.0), 0.0)
    v = mean * (1 - mean)
    return float(min(1e6, max(1.0, v / tau - 1))) if tau > 0 and v > 0 else 1e6


def site_rates(rows: DataFrame, value: str) -> tuple[DataFrame, dict]:
    """(host, path, sums) and the hyperparameters for one probability."""
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("np"), F.sum(value).alias("sp"))
    hosts = paths.groupBy("host").agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"))
    g = hosts.agg(F.sum("nh"), F.sum("sh")).first()
    n, mean = g[0] or 0, (g[1] / g[0] if g[0] else 0.5)
    mean = min(1 - 1e-6, max(1e-6, mean))
    rate = F.col("sh") / F.col("nh")
    h = hosts.agg(F.avg((rate - mean) ** 2), F.avg(F.lit(mean * (1 - mean)) / F.col("nh"))).first()
    # written: used three times, and its join with the rows is then one of plain shuffles that Spark can split
    both = stage(paths.join(hosts, "host"), "sites")
    p = both.agg(F.avg((F.col("sp") / F.col("np") - rate) ** 2), F.avg(rate * (1 - rate) / F.col("np"))).first()
    return both, {"n": n, "mean": mean, "host": _strength(mean, *h), "path": _strength(mean, *p)}


def _logit(c: Column) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def posterior(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` plus <value>_host, <value>_path (shrunken rates without the
    document itself) and <value>_post."""
    sums, k = site_rates(rows, value)
    mine = sums.withColumnsRenamed({"host": "_h", "path": "_p"})
    j = rows.join(mine, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")))
    own = F.col(value)
    host = (F.col("sh") - own + k["host"] * k["mean"]) / (F.col("nh") - 1 + k["host"])
    path = (F.col("sp") - own + k["path"] * F.col(f"{value}_host")) / (F.col("np") - 1 + k["path"])
    z = _logit(own) + _logit(F.col(f"{value}_path")) - _logit(F.lit(k["mean"]))
    return (j.withColumn(f"{value}_host", host).withColumn(f"{value}_path", path)
            .withColumn(f"{value}_post", 1 / (1 + F.exp(-z))).drop("_h", "_p", "np", "sp", "nh", "sh"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """Per document: doc_id, host, path, evidence, host_rate, path_rate,
    quality, toxic_evidence, toxic, keep."""
    quality, toxic = fit(docs, labels)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    rows = stage(evidence(docs, quality, toxic, host, path), "evidence")
    out = posterior(posterior(rows, "q"), "t")
    return out.select("doc_id", "host", "path", F.col("q").alias("evidence"), F.col("q_host").alias("host_rate"),
                      F.col("q_path").alias("path_rate"), F.col("q_post").alias("quality"), F.col("t").alias("toxic_evidence"),
                      F.col("t_post").alias("toxic"),
                      (F.col("worded") & (F.col("q_post") >= MIN_QUALITY) & (F.col("t_post") < MAX_TOXIC)).alias("keep"))
