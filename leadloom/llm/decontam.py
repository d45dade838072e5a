"""Benchmark decontamination by a generalised suffix automaton (operator 6).

The automaton holds every item's words (lower-cased A-Z; runs of digits,
letters a-z and non-ASCII characters). Training words stream through it; the
current state tells the longest suffix that occurs in an item, and:

* a match of ``window`` words or more makes those words hit;
* an item of fewer words is hit where all of it occurs.

A document word may be removed, or a document dropped once the hit share
passes ``max_coverage`` (``decontaminate``).

Scale: documents are never shuffled before the narrow per-document result. The
items are cut into words where they are read and written as pieces of at most
``BLOCK_WORDS`` words (those of a longer item overlap by a window less one word,
so each of its windows is in one piece). Pieces are gathered into blocks of at most
``BLOCK_WORDS`` words; the driver sees one row per written group of pieces, and
holds and broadcasts the words of a block at a time. Documents pass through the automaton of
each block; after ``CHAIN`` blocks their marks are written and the broadcasts
dropped, so plans and broadcasts keep their bound however long the benchmark is. Only
stretches whose neighbouring words also are neighbours in an item reach the automaton.

Edge cases: a null or empty text has no words; repeated documents are marked each; an
empty table of documents gives an empty result; an item without words takes no
part; a null item id counts as the id ``''``; repeated items count once per
id; an empty benchmark hits nothing; columns beside the ids and texts are
carried by ``decontaminate`` and otherwise ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_arrow, private, schema_ddl, stage, unstage

WINDOW = 10
BLOCK_WORDS = 100_000
#: blocks whose automata documents pass before their marks are written
CHAIN = 8
#: bytes outside words become spaces, A-Z become a-z
_WORD = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences with, for every state,
    the items that contain its strings and, for short items, where they end."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[int]] = []
        for _, seq in items:
            last, own = 0, []
            for c in seq:
                last = self._extend(last, c)
                own.append(last)
            ends.append(own)
        self.items: list[set[str]] = [set() for _ in self.next]
        # every state on the suffix path of an item's prefix holds that item
        for (name, _), own in zip(items, ends):
            seen: set[int] = set()
            for s in own:
                while s > 0 and s not in seen:
                    seen.add(s)
                    s = self.link[s]
            for s in seen:
                self.items[s].add(name)
        # whole short items: state of the item -> its number of words
        self.short: dict[int, dict[int, set[str]]] = {}
        for (name, seq), own in zip(items, ends):
            if 0 < len(seq) < window:
                s = own[-1]             # the shortest state whose longest string covers the item
                while self.len[self.link[s]] >= len(seq):
                    s = self.link[s]
                self.short.setdefault(s, {}).setdefault(len(seq), set()).add(name)
        # nearest state on the suffix path (itself included) where a short item ends
        self.near = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of ``q`` that ``p`` followed by ``c`` makes."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        cur, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur

    def scan(self, ids, lo: int, hi: int, hit: np.ndarray, found: set[str]) -> None:
        """Stream ids[lo:hi]; mark hit words and the items they belong to."""
        state, length, window = 0, 0, self.window
        for i in range(lo, hi):
            c = int(ids[i])
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if length >= window:
                hit[i + 1 - window:i + 1] = True    # longer matches were marked on the way
                s = state
                while self.len[self.link[s]] >= window:
                    s = self.link[s]
                found |= self.items[s]
            s = self.near[state]
            while s > 0:
                for n, names in self.short[s].items():
                    if n <= length:
                        hit[i + 1 - n:i + 1] = True
                        found |= names
                s = self.near[self.link[s]] if self.link[s] > 0 else -1


class Matcher:
    """The automaton of one block of items with the filters before it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq])
                 for name, seq in items if seq]
        self.automaton = SuffixAutomaton(coded, window)
        self.shortest = min((min(len(seq), window) for _, seq in coded), default=0)
        v = self.base = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * v + b for _, s in coded for a, b in zip(s, s[1:])], dtype=np.int64))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(which words are hit, names of the items with occurring windows)."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        if not self.shortest or len(words) < self.shortest:
            return hit, found
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = ids >= 0
        if self.shortest > 1 and len(self.pairs):
            key = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = (self.pairs[at] == key) & known[:-1] & known[1:]
            need = self.shortest - 1
        else:
            joined, need = known, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi - lo >= need:
                self.automaton.scan(ids, lo, hi + (joined is not known), hit, found)
        return hit, found


def item_pieces(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The items' words, staged: (grp, name, words joined by a space, n) in pieces of
    at most ``block_words`` words (a window at least); the pieces of a group, made
    by one task, have no more together."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    most = max(block_words, window)

    def cut(batches):
        import uuid
        task, group, size = uuid.uuid4().hex[:16], 0, 0
        for b in batches:
            out: dict[str, list] = {"grp": [], "name": [], "words": [], "n": []}
            for name, text in zip(b.column("name").to_pylist(), binary_column(b, "text")):
                seq = words_of(text)
                for lo in range(0, max(1, len(seq) - window + 1) if seq else 0, most - window + 1):
                    piece = seq[lo:lo + most]
                    if size and size + len(piece) > most:
                        group, size = group + 1, 0
                    size += len(piece)
                    for c, v in zip(out, (f"{task}-{group}", name, b" ".join(piece), len(piece))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["grp"], pa.string()), pa.array(out["name"], pa.string()),
                                              pa.array(out["words"], pa.binary()), pa.array(out["n"], pa.int64())], names=list(out))

    return stage(map_arrow(rows, cut, "grp string, name string, words binary, n long"), "items")


def item_blocks(pieces: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of (item name, words): whole groups of pieces, at most ``block_words``
    words or one group. A block is fetched when it is asked for."""
    names, size = [], 0

    def fetch():
        return [(r["name"], r["words"].split()) for r in pieces.where(F.col("grp").isin(names)).select("name", "words").collect()]

    # one row per group: about the benchmark's words over ``block_words``, and one a task
    for r in pieces.groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").collect():
        if names and size + r["n"] > block_words:
            yield fetch()
            names, size = [], 0
        names.append(r["grp"])
        size += r["n"]
    if names:
        yield fetch()


_MATCHERS: dict[int, Matcher] = {}


def _matcher(broadcast) -> Matcher:
    """One automaton per worker and block."""
    if broadcast.value[0] not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[broadcast.value[0]] = Matcher(broadcast.value[1], broadcast.value[2])
    return _MATCHERS[broadcast.value[0]]


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"s": int(a), "e": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` plus, under its private prefix, n_words, n_hit,
    items (names of items with occurring windows, sorted as strings) and hits
    (word spans [s, e)). Later blocks of items add to the marks of earlier ones
    in the same row."""
    import uuid
    names, own = docs.columns, private(docs)
    mine = [f"{own}{c}" for c in ("n_words", "n_hit", "items", "hits")]
    sc, live, written = docs.sparkSession.sparkContext, [], None
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    out = docs
    types = ("long", "long", "array<string>", "array<struct<s:int,e:int>>")
    schema = schema_ddl(docs) + "".join(f", {c} {t}" for c, t in zip(mine, types))
    pieces = item_pieces(benchmark, window, block_words)
    blocks = itertools.chain(item_blocks(pieces, block_words), [None])
    for k, block in enumerate(blocks):
        if block is None and k:              # the last one has been; without items one pass of none
            break
        if len(live) == CHAIN:
            done, old = stage(out, "marks"), written
            out = written = done
            while live:
                live.pop().destroy()
            if old is not None:
                unstage(old)
        shared = sc.broadcast((uuid.uuid4().hex, block or [], window))
        live.append(shared)

        def run(batches, shared=shared, first=k == 0):
            m = _matcher(shared)
            for b in batches:
                n_words, n_hit, items, hits = [], [], [], []
                had = None if first else (b.column(mine[2]).to_pylist(), b.column(mine[3]).to_pylist())
                for i, t in enumerate(binary_column(b, "text")):
                    words = words_of(t)
                    hit, found = m.of(words)
                    if had:
                        found = found | set(had[0][i])
                        for x in had[1][i]:
                            hit[x["s"]:x["e"]] = True
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(found))
                    hits.append(_spans(hit) if n_hit[-1] else [])
                cols = {c: b.column(c) for c in names}
                cols |= dict(zip(mine, (pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                                        pa.array(items, pa.list_(pa.string())), pa.array(hits, span))))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        out = map_arrow(out, run, schema)
    unstage(pieces)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts = docs.select("doc_id", "text")
    own = private(texts)
    m = mark(texts, benchmark, window)
    return m.select("doc_id", F.col(f"{own}n_words").alias("n_words"), F.col(f"{own}n_hit").alias("n_hit"),
                    F.size(f"{own}items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(f"{own}items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col(f"{own}n_hit") > 0).alias("contaminated"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes of the words in ``spans``, each span from its
    first word's first byte to its last word's last."""
    raw = text.encode()
    folded = raw.translate(FOLD)
    starts, ends, at = [], [], 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for s, e in spans:
        out.append(raw[done:starts[s]])
        done = ends[e - 1]
    out.append(raw[done:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_coverage: float = 0.5) -> DataFrame:
    """Same columns as ``docs``: hit spans are cut out of the text; documents
    whose hit words make up more than ``max_coverage`` of all go. Column
    ``n_chars``, where there is one, follows the new text."""
    names, own = docs.columns, private(docs)
    m = mark(docs, benchmark, window).where(F.col(f"{own}n_hit") <= max_coverage * F.col(f"{own}n_words"))

    def run(batches):
        for b in batches:
            hits, texts = b.column(f"{own}hits").to_pylist(), b.column("text").to_pylist()
            new = [remove_spans(t, [(x["s"], x["e"]) for x in h]) if h else t for t, h in zip(texts, hits)]
            cols = {c: b.column(c) for c in names} | {"text": pa.array(new, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    out = map_arrow(m, run, schema_ddl(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


