"""Best-two-fit packing of token sequences (operator 7).

Documents become token ids plus one end id. Documents longer than a sequence
are cut into full pieces, the remainder first. Only lengths matter for the
packing, and there are at most ``capacity`` of them, so the plan is made from
the histogram of lengths: best-two-fit on length classes gives a few hundred
patterns (the lengths of one sequence) with the number of sequences that use
each. Tasks then give every piece its place from its rank within its length.

* fill greedily: the longest unpacked length that fits the gap, until none does;
* replace: the smallest length of the sequence gives way to two unpacked
  lengths that together fill the widened gap more tightly, if any do.

Scale: texts are read once and never shuffled; a piece travels as a narrow row.
Ranks come from per-task counts and a prefix sum over (length, block), so no
length class meets in one task. The driver sees one row per length.

Edge cases: a null text is empty (one piece, the end id alone); repeated rows
each get their own pieces; an empty table gives an empty result; columns
beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, stage

CAPACITY = 1024
END_ID = 2
#: distinct text chunks whose ids a worker keeps (memory only; ids don't change)
CACHE_ENTRIES = 300_000
PUNCTUATION = ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """pre-token -> ids, by the BPE itself on a miss."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class _Chunks(dict):
    """chunk without its leading space -> ids of the chunk with it."""

    def __init__(self, words: _Words, pieces):
        super().__init__()
        self.words, self.pieces = words, pieces

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        body = chunk.rstrip(PUNCTUATION)
        if body.isalpha():              # one run of letters, then one of punctuation
            ids = self.words[" " + body]
            if len(body) < len(chunk):
                ids += self.words[chunk[len(body):]]
        else:
            ids = self.text(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text)))


class ChunkEncoder:
    """Token ids of whole texts by a byte-level BPE file of the ``tokenizers``
    library, by ``tiktoken`` on the file's merges. A text is cut at the file's
    added tokens, and before every space that a non-space follows, where the
    pre-tokenizer always cuts too; ids are kept per chunk."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte <-> printable character alphabet of byte-level BPE, from its rule
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take the space around them are not supported")
        ranks = {bytes(byte_of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items()
                 if tok not in special}
        bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=ranks, special_tokens={})
        self.chunks = _Chunks(_Words(bpe.encode_ordinary), regex.compile(public_tokenizers.PATTERN).findall)
        self.odd_space = regex.compile(r" (?=\s|$)").search
        # the library finds the file's added tokens in any text, the longest first
        self.added = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def forget(self) -> None:
        """Empty the caches (at the end of a task)."""
        self.chunks.clear()
        self.chunks.words.clear()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``, end id not included."""
        if self.at_added is not None:
            parts = self.at_added(text)
            if len(parts) > 1:
                return b"".join(self.added.get(p) or self.ordinary(p) for p in parts if p)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if self.odd_space(text):
            return self.chunks.text(text)
        first, *rest = text.split(" ")
        return self.chunks.text(first) + b"".join(map(self.chunks.__getitem__, rest))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the remainder first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
                "block string, rank_in_block long")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the task's
    block and the piece's rank among the block's pieces of that length; with
    ``with_ids`` also the ids themselves."""
    path = tokenizer or default_tokenizer()
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        block, seen = uuid.uuid4().hex, np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: list[tuple] = []
            held = []
            for doc_id, text in zip(ids_of, texts):
                ids = enc.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    raw = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(raw), seen[length]))
                    seen[length] += 1
                    if with_ids:
                        held.append(np.frombuffer(raw, dtype="<u4").astype(np.int32))
            if not rows:
                continue
            cols = list(zip(*rows))
            out = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()),
                   "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()),
                   "ids_crc32": pa.array(cols[4], pa.int64()),
                   "block": pa.array([block] * len(rows), pa.string()),
                   "rank_in_block": pa.array(cols[5], pa.int64())}
            if with_ids:
                out["ids"] = pa.array(held, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)
        enc.forget()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


# ------------------------------------------------------------------ the plan


def _largest(avail: np.ndarray, most: int) -> int:
    """Largest length of at most ``most`` that is still unpacked (0: none)."""
    got = np.flatnonzero(avail[:most + 1])
    return int(got[-1]) if len(got) else 0


def _two(avail: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest of at most ``room`` and
    above ``more_than``."""
    have = np.flatnonzero(avail[:room])
    have = have[have > 0]
    if not len(have):
        return None
    best = None
    at = np.searchsorted(have, room - have, side="right") - 1
    for a, j in zip(have, at):
        if j < 0:
            continue
        b = int(have[j])
        if b == a and avail[a] < 2:
            if j == 0:
                continue
            b = int(have[j - 1])
        if a + b > (best[0] if best else more_than):
            best = (int(a) + b, int(a), b)
            if best[0] == room:
                break
    return best[1:] if best else None


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, sequences with these lengths)] that use every
    item of ``counts`` {length: number} once."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        avail[length] = n
    plan = []
    while (longest := _largest(avail, capacity)):
        bin_, gap = [], capacity
        nxt = longest
        while nxt:                                   # greedy fill
            bin_.append(nxt)
            avail[nxt] -= 1
            gap -= nxt
            nxt = _largest(avail, gap)
        while gap and len(bin_) > 1:                 # two for the smallest
            small = bin_[-1]
            pair = _two(avail, gap + small, small)
            if pair is None:
                break
            bin_.pop()
            avail[small] += 1
            for x in pair:
                avail[x] -= 1
            gap += small - sum(pair)
            bin_ = sorted([*bin_, *pair], reverse=True)
        need = {x: bin_.count(x) for x in set(bin_)}
        more = min(int(avail[x]) // k for x, k in need.items())   # the same again while it lasts
        for x, k in need.items():
            avail[x] -= more * k
        plan.append((bin_, more + 1))
    return plan


def rank_ranges(plan: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """length -> [(first rank, first sequence, offset)], ranks ascending."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            first = taken.get(x, 0)
            out.setdefault(x, []).append((first, sequence, offset))
            taken[x] = first + times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    staged = stage(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    per_block = staged.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = {length: tuple(np.array(c, dtype=np.int64) for c in zip(*v))
              for length, v in rank_ranges(best_two_fit(counts, capacity)).items()}
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (staged.join(base, ["length", "block"])
              .withColumn("rank", F.col("base") + F.col("rank_in_block")).drop("base", "rank_in_block", "block"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    fields += ", ids array<int>" if with_ids else ""

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                m = length == x
                first, sequence, offset = ranges[int(x)]
                i = np.searchsorted(first, rank[m], side="right") - 1
                seq[m], off[m] = sequence[i] + rank[m] - first[i], offset[i]
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols |= {"sequence_id": pa.array(seq), "offset": pa.array(off)}
            if with_ids:
                cols["ids"] = b.column("ids")
            yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(ranked, place, fields)
