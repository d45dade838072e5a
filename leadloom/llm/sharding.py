"""Best-fit-decreasing sharding of indivisible groups (operator 2).

Documents of equal text are one group and share a shard; the shards' sizes in
bytes come out nearly equal (law ``bytes``). Bins have a fixed capacity; groups
enter by decreasing size the bin whose remaining capacity is tightest, found in
a balanced tree of remaining capacities.

Two levels keep every task bounded. First each task packs its groups, at most
``GROUPS`` and one batch at a time, into crates of ``1 / (shards * CRATES_PER_SHARD)`` of all bytes (a
larger group is a crate of its own). Then the crates, at most about two per
capacity and one open crate per portion of groups, are packed into the shards, with
the least capacity for which best-fit-decreasing needs no more than the given
number. A group larger than an even share gets its own shard first, and the
rest is evened out over the others.

Slots are gapless without numbering a shard in one task: shard, crate, group
and salted part of a group each know how many rows come before them.

Edge cases: null text has size 16 and is one group with the empty text;
repeated rows are rows of the same group, numbered arbitrarily; null ids come
first within their part; an empty table gives an empty result; columns beside
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, stage, text_or_empty

SHARDS = 40
CRATES_PER_SHARD = 256
ROW_BYTES = 16
#: groups that a task packs into crates at a time (narrow rows, some MB)
GROUPS = 500_000
#: parts into which the rows of one group are numbered
SALTS = 1024


class Capacities:
    """A treap of (remaining capacity, bin): balanced in expectation by hashed
    priorities, so the tightest bin for a size is found in logarithmic time."""

    def __init__(self):
        self.key: list[tuple[int, int]] = []
        self.prio: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.free: list[int] = []
        self.root = -1

    def _node(self, key: tuple[int, int]) -> int:
        prio = (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xD1B54A32D192ED03) * 0x94D049BB133111EB >> 7 & (1 << 57) - 1
        if self.free:
            i = self.free.pop()
            self.key[i], self.prio[i], self.left[i], self.right[i] = key, prio, -1, -1
            return i
        self.key.append(key)
        self.prio.append(prio)
        self.left.append(-1)
        self.right.append(-1)
        return len(self.key) - 1

    def add(self, key: tuple[int, int]) -> None:
        new = self._node(key)
        parent, side, at = -1, 0, self.root
        while at >= 0 and self.prio[at] >= self.prio[new]:
            parent, side = at, int(self.key[at] < key)
            at = self.right[at] if side else self.left[at]
        self._hang(parent, side, new)
        # split what was there into what is below and above the key
        lo, hi = (new, 0), (new, 1)
        while at >= 0:
            if self.key[at] < key:
                self._hang(*lo, at)
                lo, at = (at, 1), self.right[at]
            else:
                self._hang(*hi, at)
                hi, at = (at, 0), self.left[at]
        self._hang(*lo, -1)
        self._hang(*hi, -1)

    def _hang(self, parent: int, side: int, child: int) -> None:
        if parent < 0:
            self.root = child
        elif side:
            self.right[parent] = child
        else:
            self.left[parent] = child

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the least key whose capacity is at least ``least``."""
        best, where, parent, side, at = -1, (-1, 0), -1, 0, self.root
        while at >= 0:
            if self.key[at][0] >= least:
                best, where = at, (parent, side)
                parent, side, at = at, 0, self.left[at]
            else:
                parent, side, at = at, 1, self.right[at]
        if best < 0:
            return None
        a, b, (parent, side) = self.left[best], self.right[best], where
        while a >= 0 and b >= 0:         # join the two subtrees in its place
            if self.prio[a] >= self.prio[b]:
                self._hang(parent, side, a)
                parent, side, a = a, 1, self.right[a]
            else:
                self._hang(parent, side, b)
                parent, side, b = b, 0, self.left[b]
        self._hang(parent, side, a if a >= 0 else b)
        self.free.append(best)
        return self.key[best]


def best_fit_decreasing(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Bin of every item; None once more than ``most`` bins would be needed.
    An item larger than the capacity has a bin of its own."""
    tree, out, bins = Capacities(), np.empty(len(sizes), dtype=np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        got = tree.take(size)
        if got is None:
            if most is not None and bins >= most:
                return None
            got = (max(capacity, size), bins)
            bins += 1
        out[i] = got[1]
        tree.add((got[0] - size, got[1]))
    return out


def even_bins(sizes: np.ndarray, bins: int) -> np.ndarray:
    """Items to ``bins`` bins of nearly equal size: items above an even share
    alone, the rest by best-fit-decreasing at the least capacity that works."""
    out = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    used, left = 0, int(sizes.sum())
    while used < len(order) and bins - used > 1 and int(sizes[order[used]]) * (bins - used) > left:
        out[order[used]] = used
        left -= int(sizes[order[used]])
        used += 1
    rest, n = order[used:], bins - used
    if not len(rest):
        return out
    own = sizes[rest]
    lo = max(int(own.max()), -(-left // n))
    hi = lo + int(own.max())             # enough: a bin only closes when it is fuller than an even share
    best = None
    while lo < hi:
        mid = (lo + hi) // 2
        got = best_fit_decreasing(own, mid, n)
        if got is None:
            lo = mid + 1
        else:
            hi, best = mid, got
    if best is None or int(best.max()) >= n:
        best = best_fit_decreasing(own, hi, n)
    while best is None:                  # best-fit is not monotone in the capacity
        hi += max(1, hi // 1000)
        best = best_fit_decreasing(own, hi, n)
    out[rest] = used + best
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and
    grown_shard (null: the law is not by key)."""
    spark = docs.sparkSession
    raw = text_or_empty().cast("binary")
    rows = stage(docs.select(
        "doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("g"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(SALTS)).cast("int").alias("salt")), "rows")
    parts = rows.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, total // (shards * CRATES_PER_SHARD))

    most = GROUPS

    def crate(batches):
        import uuid
        held, n_held = [], 0
        for b in batches:
            held.append(b)
            n_held += b.num_rows
            if n_held >= most:
                yield pack(pa.Table.from_batches(held), uuid.uuid4().hex[:16])
                held, n_held = [], 0
        if n_held:
            yield pack(pa.Table.from_batches(held), uuid.uuid4().hex[:16])

    def pack(groups, portion):
        g = groups.column("g").combine_chunks()
        n, size = groups.column("n").to_numpy(), groups.column("bytes").to_numpy()
        box = best_fit_decreasing(size, capacity)
        order = np.argsort(box, kind="stable")
        at = np.cumsum(n[order]) - n[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(box[order])) + 1))
        at -= np.repeat(at[first], np.diff(np.concatenate((first, [len(order)]))))
        return pa.RecordBatch.from_pydict({
            "g": g.take(pa.array(order)), "task": pa.array([portion] * len(order)),
            "crate": pa.array(box[order]), "before": pa.array(at), "n": pa.array(n[order]), "bytes": pa.array(size[order])})

    boxed = stage(map_arrow(groups, crate, "g binary, task string, crate long, before long, n long, bytes long"), "crates")
    # at most two crates per capacity and one open crate per portion
    crates = boxed.groupBy("task", "crate").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).toPandas()
    crates = crates.sort_values(["bytes", "n", "task", "crate"], ascending=[False, False, True, True], ignore_index=True)
    crates["shard"] = even_bins(crates["bytes"].to_numpy(dtype=np.int64), shards) if len(crates) else []
    crates["shift"] = crates.groupby("shard")["n"].cumsum() - crates["n"] if len(crates) else []
    plan = spark.createDataFrame(crates[["task", "crate", "shard", "shift"]].astype({"shard": "int32", "shift": "int64", "crate": "int64"})
                                 if len(crates) else [], "task string, crate long, shard int, shift long")
    placed = boxed.join(F.broadcast(plan), ["task", "crate"]).select(
        "g", "shard", (F.col("before") + F.col("shift")).alias("base"))
    before = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.select("g", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part"))
               .join(placed, "g").select("g", "salt", "shard", (F.col("base") + F.col("part")).alias("base")))
    at = F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id")) - 1
    return (rows.join(offsets, ["g", "salt"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + at).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
