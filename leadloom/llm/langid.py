"""Language identification by a byte convolutional network (operator 9).

Bytes of the lower-cased text fall into 64 symbols. Filters of several widths
slide over fixed-length windows, each filter keeps its largest response in the
window (max pooling) and a softmax layer gives the language. The network is
trained in numpy (Adam, cross-entropy) on windows of labelled texts and applied
to every window of every whole text; a text's probabilities are the mean of
its windows' log-probabilities, weighted by their letters.

An embedding followed by a filter is one table per offset, so a filter of
width 4 is two gathers from a table of symbol pairs.

Scale: texts are read once where they lie; nothing is shuffled. Training uses
at most ``PER_LANG`` documents a language and ``WINDOWS_PER_DOC`` windows of
each (the documented bound of what the driver gathers: a few MB).

Edge cases: null text, or text without a letter: ``und`` with score 0. Texts
shorter than a window are padded. No labelled row at all: every text is
``und``. One language only: it is predicted with score 1. Ties go to the first
language in string order. Columns beside the used ones are carried along by
``identify``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, private, schema_ddl

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANG = 500
WINDOWS_PER_DOC = 4
#: texts below this probability are rejected by the pipeline
MIN_SCORE = 0.5
UNKNOWN = "und"

#: letters of a text in any script
LETTER = r"\p{L}"


def _symbols() -> np.ndarray:
    """256 bytes -> 64 symbols: 0 padding and control, 1 space, 2 digits, 3
    other ASCII, 4..29 letters, then the bytes of longer characters: lead
    bytes share 2 symbols, continuation bytes 32 by their low bits."""
    s = np.zeros(256, dtype=np.int64)
    s[33:127] = 3
    s[[9, 10, 11, 12, 13, 32]] = 1
    s[48:58] = 2
    for k in range(26):
        s[65 + k] = s[97 + k] = 4 + k
    s[192:224], s[224:256] = 30, 31
    s[128:192] = 32 + np.arange(64) % 32
    return s


SYMBOL = _symbols()
N_SYM = 64


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) symbols of the whole text, the last window padded with 0."""
    sym = SYMBOL[np.frombuffer(text, dtype=np.uint8)]
    n = max(1, -(-len(sym) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.int64)
    out[:len(sym)] = sym
    return out.reshape(n, WINDOW)


class ByteCNN:
    """Filters ``w[k]`` of shape (width, 64, FILTERS), biases folded into the
    softmax layer ``out`` (features, languages) with bias ``bias``."""

    def __init__(self, langs: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        self.langs = langs
        self.w = [g.normal(0, 0.3, (k, N_SYM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.out = g.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.w, self.out, self.bias]

    # ---------------------------------------------------------------- training

    def _forward(self, x: np.ndarray):
        feats, where = [], []
        for k, w in zip(WIDTHS, self.w):
            n = WINDOW - k + 1
            r = w[0][x[:, :n]]
            for j in range(1, k):
                r = r + w[j][x[:, j:j + n]]
            at = r.argmax(axis=1)
            feats.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            where.append(at)
        raw = np.concatenate(feats, axis=1)
        f = np.maximum(raw, 0)
        return raw, f, where, f @ self.out + self.bias

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64,
              rate: float = 0.01, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.params()]
        var = [np.zeros_like(p) for p in self.params()]
        step = 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for lo in range(0, len(x), batch):
                i = order[lo:lo + batch]
                xb, yb = x[i], y[i]
                raw, f, where, z = self._forward(xb)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), yb] -= 1
                p /= len(i)
                grad_f = (p @ self.out.T) * (raw > 0)
                grads = []
                for n, (k, w) in enumerate(zip(WIDTHS, self.w)):
                    gw = np.zeros_like(w)
                    gf = grad_f[:, n * FILTERS:(n + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), where[n].shape)
                    for j in range(k):
                        np.add.at(gw[j], (np.take_along_axis(xb, where[n] + j, 1), cols), gf)
                    grads.append(gw)
                grads += [f.T @ p, p.sum(axis=0)]
                step += 1
                for q, gr, m, v in zip(self.params(), grads, mean, var):
                    m += 0.1 * (gr - m)
                    v += 0.001 * (gr * gr - v)
                    q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    # ------------------------------------------------------------- application

    def compile(self) -> None:
        """Tables of symbol pairs: pair[a * 64 + b]."""
        self.tables = []
        for k, w in zip(WIDTHS, self.w):
            t = []
            for j in range(0, k - 1, 2):
                t.append((j, True, np.ascontiguousarray((w[j][:, None] + w[j + 1][None]).reshape(-1, FILTERS))))
            if k % 2:
                t.append((k - 1, False, np.ascontiguousarray(w[k - 1])))
            self.tables.append((k, t))

    def log_probs(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        """(n, languages) log-probabilities of (n, WINDOW) symbols."""
        out = np.empty((len(x), len(self.langs)), dtype=np.float32)
        for lo in range(0, len(x), chunk):
            xb = x[lo:lo + chunk]
            pair = xb[:, :-1] * N_SYM + xb[:, 1:]
            feats = []
            for k, tables in self.tables:
                n = WINDOW - k + 1
                r = None
                for j, two, t in tables:
                    got = t.take((pair if two else xb)[:, j:j + n], axis=0)
                    r = got if r is None else np.add(r, got, out=r)
                feats.append(r.max(axis=1))
            z = np.maximum(np.concatenate(feats, axis=1), 0) @ self.out + self.bias
            z -= z.max(axis=1, keepdims=True)
            out[lo:lo + chunk] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language index, probability) of each whole text."""
        xs = [windows_of(t) for t in texts]
        x = np.concatenate(xs)
        first = np.cumsum([0, *map(len, xs[:-1])])
        weight = (x >= 4).sum(axis=1).astype(np.float32)[:, None]
        z = np.add.reduceat(self.log_probs(x) * weight, first) / np.maximum(np.add.reduceat(weight, first), 1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def fold_of(c: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % folds


def has_letter(c: str = "text") -> Column:
    return F.coalesce(F.col(c).rlike(LETTER), F.lit(False))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_lang: int = PER_LANG) -> ByteCNN:
    """Train on at most about ``per_lang`` rows of each language, chosen by the
    hash of their id; rows without language or letter take no part."""
    rows = docs.where(F.col(label).isNotNull() & has_letter(text))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}      # one row per language
    langs = sorted(counts)
    net = ByteCNN(langs)
    net.compile()
    if len(langs) < 2:
        return net
    share = F.create_map(*[v for k in langs for v in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))])
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < share[F.col(label)]).select(F.col(label).alias("l"), F.col(text).alias("t"))

    def sample(batches):
        for b in batches:
            out = []
            for lang, t in zip(b.column("l").to_pylist(), b.column("t").to_pylist()):
                raw = t.encode()
                n = max(1, -(-len(raw) // WINDOW))
                for k in sorted({round(i * (n - 1) / max(1, WINDOWS_PER_DOC - 1)) for i in range(WINDOWS_PER_DOC)}):
                    out.append((lang, raw[k * WINDOW:(k + 1) * WINDOW]))
            yield pa.RecordBatch.from_pydict({"l": pa.array([o[0] for o in out], pa.string()),
                                              "w": pa.array([o[1] for o in out], pa.binary())})

    got = sorted((r["l"], bytes(r["w"])) for r in map_arrow(chosen, sample, "l string, w binary").collect())
    if not got:
        return net
    x = np.concatenate([windows_of(w) for _, w in got])
    y = np.array([langs.index(k) for k, _ in got])
    net.train(x, y)
    net.compile()
    return net


def identify(docs: DataFrame, net: ByteCNN, text: str = "text", pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the predicted language and its probability."""
    names, flag = docs.columns, f"{private(docs)}letter"
    flagged = docs.withColumn(flag, has_letter(text))
    schema = f"{schema_ddl(docs)}, `{pred}` string, `{score}` double"
    few = 256                                        # texts whose windows are held at once

    def run(batches):
        for b in batches:
            texts, letter = b.column(text).to_pylist(), b.column(flag).to_pylist()
            use = [i for i, x in enumerate(letter) if x and net.langs]
            lang, p = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for lo in range(0, len(use), few):
                part = use[lo:lo + few]
                best, prob = net.of_texts([texts[i].encode() for i in part])
                for i, k, q in zip(part, best, prob):
                    lang[i], p[i] = net.langs[k], float(q)
            cols = [b.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, pred, score])

    return map_arrow(flagged, run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    """The rows the contract lets the network learn from."""
    return docs.where(fold_of() != 1)


def predict(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    net = fit(train_rows(docs))
    held = docs.select("doc_id", (fold_of() == 1).alias("held_out"), "text")
    return identify(held, net).drop("text")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Same columns as ``docs``: texts whose language is recognised. Rejected:
    null texts, texts without a letter, and texts scored below ``min_score``."""
    names = docs.columns
    pred, score = f"{private(docs)}pred", f"{private(docs)}score"
    out = identify(docs, fit(train_rows(docs)), pred=pred, score=score)
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*[f"`{c}`" for c in names])
