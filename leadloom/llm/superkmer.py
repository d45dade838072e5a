"""Exact substring de-duplication by super-k-mer partitioning (operator 5).

Words are runs of non-space bytes, unchanged. Every ``WINDOW`` consecutive
words of one document are a window; a word goes if some window that covers it
also starts anywhere else. Consecutive windows whose least 8-word hash (the
minimiser) sits at the same place form a super-k-mer:

1. runs: every super-k-mer sends its minimiser and place, no text. Equal
   windows have equal minimisers, so a minimiser that occurs once rules its
   windows out.
2. packs: the others travel as one packed string. Equal strings collapse to
   one with a weight (map-side first), so a hot passage is one row.
3. buckets: strings meet by minimiser; their windows are sorted by rolling
   hash, equal hashes are compared word by word, and weights are summed.
4. spans: the repeated windows go back to their documents.

Scale: texts are shuffled twice by row (once for packing, once for cutting);
all else is proportional to super-k-mers or to repeated text. The strings at the
edges of a shared passage hold words of their own documents, so they do not
collapse: the strings of a minimiser with more than ``HOT_VARIANTS`` different
ones are split into single windows, which are counted by their 128-bit digest
(map-side first) and flagged by a join that Spark can split. Partitions of step 3 hold about ``BUCKET_BYTES``.

Edge cases: null and empty texts have no words; texts shorter than a window
are kept whole; repeated rows (same id, same text) count as repeats of each
other; null ids are allowed; an empty table gives an empty result; columns
beside ``doc_id`` and ``text`` are carried by ``cut``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHashes, binary_column, blocks_for, map_arrow, mix64, private, reclaim, rolling, schema_ddl, stage,
                     text_or_empty, unstage)

WINDOW = 35
MMER = 8
#: digests of strings a packing task remembers, to write each string once
SEEN = 500_000
HOT_VARIANTS = 2_000
BUCKET_BYTES = 8 << 20


def super_kmers(h: np.ndarray, window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of a
    sequence of word hashes."""
    r = rolling(h, mmer)
    windows = len(h) - window + 1
    if windows <= 0:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    v, p, size, span = mix64(r), np.arange(len(r)), 1, window - mmer + 1

    def least(a, b):                     # the leftmost of equal ones
        return np.where(v[b] < v[a], b, a)

    while 2 * size <= span:
        p, size = least(p[:-size], p[size:]), 2 * size
    p = least(p[:windows], p[span - size:span - size + windows])
    first = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1))
    return r[p[first]], first, np.diff(np.concatenate((first, [windows])))


def _rows(docs: DataFrame) -> DataFrame:
    """The row identity: id and text hash."""
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_t"), "text")


def _same(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_t"] == b["_t"])


def runs(docs: DataFrame, window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """(m, _id, _t, s, n): minimiser, row, first window, windows."""
    rows = _rows(docs)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            m, at, s, n = [], [], [], []
            for i, t in enumerate(binary_column(b, "text")):
                words = t.split() if t else []
                if len(words) >= window:
                    x, y, z = super_kmers(hashes.of(words), window, mmer)
                    m.append(x)
                    s.append(y)
                    n.append(z)
                    at.append(np.full(len(x), i))
            if not m:
                continue
            where = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_pydict({
                "m": pa.array(np.concatenate(m).view(np.int64)), "_id": b.column("_id").take(where),
                "_t": b.column("_t").take(where), "s": pa.array(np.concatenate(s).astype(np.int32)),
                "n": pa.array(np.concatenate(n).astype(np.int32))})

    id_type = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows, run, f"m long, _id {id_type}, _t long, s int, n int")


def packs(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(m, _id, _t, s, ph, packed): the wanted super-k-mers (_rid, _rt, runs)
    as strings; a string that the task has written is null."""
    rows = _rows(docs)
    both = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_rid"]) & (rows["_t"] == wanted["_rt"])).drop("_rid", "_rt")

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            m, at, s, ph, packed = [], [], [], [], []
            for i, (t, want) in enumerate(zip(binary_column(b, "text"), b.column("runs").to_pylist())):
                words = t.split()
                for x in want:
                    text = b" ".join(words[x["s"]:x["s"] + x["n"] + window - 1])
                    m.append(x["m"])
                    at.append(i)
                    s.append(x["s"])
                    ph.append(hashlib.md5(text).digest())
                    packed.append(None if ph[-1] in seen else text)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ph[-1])
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "m": pa.array(m, pa.int64()), "_id": b.column("_id").take(where), "_t": b.column("_t").take(where),
                "s": pa.array(s, pa.int32()), "ph": pa.array(ph, pa.binary()), "packed": pa.array(packed, pa.binary())})

    id_type = rows.schema["_id"].dataType.simpleString()
    return map_arrow(both, run, f"m long, _id {id_type}, _t long, s int, ph binary, packed binary")


def _hot_spans(hot: DataFrame, window: int) -> DataFrame:
    """(ph, spans) of strings (ph, packed, weight) of hot minimisers, by their
    single windows."""
    def run(batches):
        for b in batches:
            ph, first, digest, weight = [], [], [], []
            for own, packed, n in zip(*(b.column(c).to_pylist() for c in ("ph", "packed", "weight"))):
                words = packed.split(b" ")
                for j in range(len(words) - window + 1):
                    ph.append(own)
                    first.append(j)
                    digest.append(hashlib.md5(b" ".join(words[j:j + window])).digest())
                    weight.append(n)
            yield pa.RecordBatch.from_pydict({"ph": pa.array(ph, pa.binary()), "first": pa.array(first, pa.int32()),
                                              "digest": pa.array(digest, pa.binary()), "weight": pa.array(weight, pa.int64())})

    # both written, so that the join is of plain shuffles and a hot window can be split
    windows = stage(map_arrow(hot, run, "ph binary, first int, digest binary, weight long"), "windows")
    twice = stage(windows.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1").select("digest"), "twice")
    return (windows.select("ph", "first", "digest").join(twice, "digest").groupBy("ph")
            .agg(F.collect_list(F.struct(F.col("first").alias("a"), (F.col("first") + 1).alias("b"))).alias("spans")))


def count_windows(packed: list[bytes], weight: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur twice or more over all
    strings, weights counted."""
    ids: dict[bytes, int] = {}
    seqs = [np.fromiter((ids.setdefault(w, len(ids)) for w in p.split(b" ")), dtype=np.int64) for p in packed]
    lens = np.array([len(s) for s in seqs])
    flat = np.concatenate(seqs)
    base = np.concatenate(([0], np.cumsum(lens)[:-1]))
    per = lens - window + 1
    owner = np.repeat(np.arange(len(seqs)), per)
    start = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    h = rolling(mix64(flat.view(np.uint64)), window)[start]
    order = np.argsort(h, kind="stable")
    total = np.zeros(len(h), dtype=np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(h[order])) + 1, [len(h)]))
    total[order] = np.repeat(np.add.reduceat(weight[owner][order], cut[:-1]), np.diff(cut))
    # equal hashes: compare with the first of the group, word by word
    lead = np.repeat(order[cut[:-1]], np.diff(cut))
    check = np.flatnonzero(np.repeat(np.diff(cut) > 1, np.diff(cut)))
    wrong = np.zeros(len(check), dtype=bool)
    for j in range(window):
        wrong |= flat[start[order[check]] + j] != flat[start[lead[check]] + j]
    if wrong.any():                      # different windows of one hash: count these groups by their words
        odd = np.isin(h, h[order[check[wrong]]])
        exact: dict[bytes, int] = {}
        names = {int(i): flat[start[i]:start[i] + window].tobytes() for i in np.flatnonzero(odd)}
        for i, k in names.items():
            exact[k] = exact.get(k, 0) + int(weight[owner[i]])
        for i, k in names.items():
            total[i] = exact[k]
    return np.split(total > 1, np.cumsum(per)[:-1])


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated(strings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ph, spans): the runs of repeated windows [a, b) of each string."""
    size = strings.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    parts = max(blocks_for(size, BUCKET_BYTES), int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written, so that the planner knows its size: no shuffle of the strings while it is small
    variants = stage(strings.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_VARIANTS).select("m"), "hot")
    hot = strings.join(variants, "m", "left_semi").select("ph", "packed", "weight")
    dealt = strings.join(variants, "m", "left_anti").select("m", "ph", "packed", "weight").repartition(parts, "m")

    def run(batches):
        ph, packed, weight = [], [], []
        for b in batches:                # one partition: every string of its minimisers
            for own, c in zip((ph, packed, weight), ("ph", "packed", "weight")):
                own += b.column(c).to_pylist()
        if not ph:
            return
        out_ph, out = [], []
        for x, flags in zip(ph, count_windows(packed, np.array(weight), window)):
            if flags.any():
                out_ph.append(x)
                out.append([{"a": a, "b": b} for a, b in spans_of(flags)])
        yield pa.RecordBatch.from_pydict({"ph": pa.array(out_ph, pa.binary()), "spans": pa.array(
            out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    cold = map_arrow(dealt, run, "ph binary, spans array<struct<a:int,b:int>>")
    return cold if variants.isEmpty() else cold.union(_hot_spans(hot, window))


def mark(docs: DataFrame, spans: str, window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """All columns of ``docs`` plus column ``spans``: word spans [a, b) that
    repeated windows cover (overlapping, any order; null where there are none)."""
    spark = docs.sparkSession
    found = stage(runs(docs, window, mmer), "runs")
    # written, so that both sides of the join are plain shuffles and a hot minimiser can be split
    often = stage(found.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m"), "often")
    wanted = stage(found.join(often, "m", "left_semi").groupBy(F.col("_id").alias("_rid"), F.col("_t").alias("_rt"))
                   .agg(F.collect_set(F.struct("m", "s", "n")).alias("runs")), "wanted")
    unstage(found)
    unstage(often)
    reclaim(spark)
    packed = stage(packs(docs, wanted, window), "packs")
    unstage(wanted)
    reclaim(spark)
    strings = stage(packed.groupBy("ph").agg(F.first("m").alias("m"), F.first("packed", ignorenulls=True).alias("packed"),
                                             F.count(F.lit(1)).alias("weight")), "strings")
    reclaim(spark)
    twice = repeated(strings, window)
    covered = packed.select("_id", "_t", "s", "ph").join(twice, "ph").select(
        F.col("_id").alias("_rid"), F.col("_t").alias("_rt"),
        F.transform("spans", lambda x: F.struct((x.a + F.col("s")).alias("a"),
                                                (x.b + F.col("s") + (window - 1)).alias("b"))).alias("spans"))
    per_row = stage(covered.groupBy("_rid", "_rt").agg(F.flatten(F.collect_list("spans")).alias("spans")),
                    "spans")
    unstage(packed)
    unstage(strings)
    reclaim(spark)
    own = private(docs)
    rows = docs.withColumn(f"{own}t", F.xxhash64(text_or_empty()))
    side = per_row.select(F.col("_rid").alias(f"{own}rid"), F.col("_rt").alias(f"{own}rt"), F.col("spans").alias(spans))
    both = rows.join(side, rows["doc_id"].eqNullSafe(side[f"{own}rid"]) & (rows[f"{own}t"] == side[f"{own}rt"]), "left")
    return both.drop(f"{own}t", f"{own}rid", f"{own}rt")


def gone(n_words: int, spans: list[dict] | None) -> np.ndarray:
    """Which of a document's words the spans cover."""
    out = np.zeros(n_words, dtype=bool)
    for x in spans or ():
        out[x["a"]:x["b"]] = True
    return out


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    marked = mark(docs.select("doc_id", "text"), "spans", window)

    def run(batches):
        for b in batches:
            n, r, sha = [], [], []
            for t, spans in zip(binary_column(b, "text"), b.column("spans").to_pylist()):
                words = t.split() if t else []
                if spans:
                    off = gone(len(words), spans)
                    kept = [w for w, x in zip(words, off) if not x]
                else:
                    kept = words
                n.append(len(words))
                r.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                                              "n_removed": pa.array(r, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(marked, run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def without(text: bytes, off: np.ndarray) -> bytes:
    """``text`` without the marked words, each stretch from its first word's
    first byte to its last word's last."""
    out, done, at, inside = [], 0, 0, False
    for w, x in zip(text.split(), off):
        at = text.index(w, at)
        if x and not inside:
            out.append(text[done:at])
        at += len(w)
        if x:
            done = at
        inside = bool(x)
    out.append(text[done:])
    return b"".join(out)


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Same rows and columns as ``docs`` with the repeated words cut out of the
    text; ``n_chars``, where there is one, follows."""
    names, covered = docs.columns, f"{private(docs)}spans"
    marked = mark(docs, covered, window)

    def run(batches):
        for b in batches:
            new = []
            for t, spans in zip(binary_column(b, "text"), b.column(covered).to_pylist()):
                new.append(without(t, gone(len(t.split()), spans)).decode() if spans else None if t is None else t.decode())
            cols = {c: b.column(c) for c in names} | {"text": pa.array(new, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    out = map_arrow(marked, run, schema_ddl(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
