"""Probabilistic suffix tree over words (operator 1).

Symbols are lower-cased words and the end of a text. A context is the run of
words before a symbol. The tree's root is the smoothed unigram distribution; a
context of ``d`` words becomes a node if

* it occurs at least ``MIN_COUNT`` times in training, a count that stays the
  same however large the corpus is, so the tree grows with it,
* its parent (the context without its oldest word) is a node, and the context
  without its newest word was a candidate, and
* the Kullback-Leibler divergence of its next-symbol distribution from its
  parent's is at least ``DIVERGENCE`` nats.

Depths are added until one has no node. A node stores every symbol that follows
it twice or more. A stored symbol seen n times has (n - DISCOUNT) / total; the
rest of the mass follows the parent. A text is scored symbol by symbol at the
deepest node that is a suffix of what came before.

Scale: texts are read once and coded into blocks of about ``BLOCK_BYTES``
(integer ids, a vocabulary per block). A block asks for the training counts of
its distinct words and, a depth at a time, of its distinct (context, symbol)
pairs that can be stored. Pairs are dealt by their context over buckets that
grow in number with the corpus; a row is what one block has for one bucket, as
packed arrays, so that pairs that occur once cost a few bytes and no row. A
bucket adds up the counts, finds the nodes and answers each block in the order
of its question: the count of each pair and what each node has stored, from
which the block derives the probabilities. From depth ``CARRY`` on a block
carries only the positions whose contexts can still get longer and the words of
those contexts (``Rest``), so that a depth costs what is left to grow; the last
pass over the texts scores every position. A context of ``HOT`` occurrences or
more is dealt over several buckets by its symbols; its sums over them are
joined by context. Nothing is as large as the corpus in one place, and a
frequent word or pair is one entry per block.

Edge cases: null and empty texts are the end alone; a null id counts as held
out (its text form is empty); repeated rows are scored and counted each; without
training rows every probability is the root's for no data; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, blocks_for, map_arrow, mix64, reclaim, stage, unstage

ALPHA = 0.1
#: training occurrences from which a context is a candidate
MIN_COUNT = 20
#: least shares of a candidate (of all symbols), of a stored symbol (of its
#: context), and greatest depth: no limits unless a caller asks for them
P_MIN = 0.0
GAMMA = 0.0
DEPTH = None
DIVERGENCE = 0.05
#: a whole number of quarters: what is kept of a context travels as one
DISCOUNT = 0.75
BLOCK_BYTES = 16 << 20
#: tokens of the corpus per bucket of pairs, parts of the vocabulary, and
#: occurrences from which a context's symbols are dealt over several buckets
BUCKET_TOKENS = 2 << 20
SLOTS = 256
HOT = 1 << 20
#: depth after which blocks carry what can still grow instead of their texts
CARRY = 3
#: the end of a text in a vocabulary (no word is empty)
END = b""


def held_out(folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def pack(x: np.ndarray) -> bytes:
    """An array of 8-byte numbers, compressed byte by byte of all numbers; high
    bytes that are 0 in all of them are left out."""
    x = np.ascontiguousarray(x).view(np.uint64)
    width = (int(np.bitwise_or.reduce(x)).bit_length() + 7) // 8
    planes = b"".join([(x >> U64(8 * k)).astype(np.uint8).tobytes() for k in range(width)])
    return len(x).to_bytes(7, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype=np.int64) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7]
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=width * n, codec="zstd", asbytes=True), dtype=np.uint8)
    x = np.zeros(n, dtype="<u8")
    cells = x.view(np.uint8).reshape(n, 8)
    for k, plane in enumerate(planes.reshape(width, n)):
        cells[:, k] = plane
    return x.view(dtype)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased words of texts, flat, and the number of each text's."""
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lens, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0       # white space at an end leaves an empty word
    if not full.all():
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[full], minlength=len(lens))
        flat = flat.filter(pa.array(full))
    return lens, flat


def code_blocks(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of three kinds, staged: documents (block, at, doc_id, train), their
    symbols in pieces of many documents (block, at of the first, flags, lens,
    ids, tokens), and vocabularies by slot (block, slot, lids, toks, counts) with the
    training count of each word."""
    def run(batches):
        vocabulary: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        counts: list[np.ndarray] = []
        size, at, block = 0, 0, uuid.uuid4().int >> 65

        def close():
            nonlocal size, at, block, vocabulary
            n = np.zeros(len(vocabulary), dtype=np.int64)
            for x in counts:
                n[:len(x)] += x
            words, own = list(vocabulary), block
            vocabulary = defaultdict(itertools.count().__next__)
            counts.clear()
            size, at, block = 0, 0, uuid.uuid4().int >> 65
            slots = np.fromiter((zlib.crc32(w) % SLOTS for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(slots, kind="stable")
            bounds = np.searchsorted(slots[order], np.arange(SLOTS + 1))
            parts = [(k, order[lo:hi]) for k, (lo, hi) in enumerate(itertools.pairwise(bounds)) if hi > lo]
            yield out(own, len(parts), slot=pa.array([k for k, _ in parts], pa.int32()),
                      lids=pa.array([pack(np.diff(x, prepend=0)) for _, x in parts], pa.binary()), counts=pa.array([pack(n[x]) for _, x in parts], pa.binary()),
                      toks=pa.array([b"\n".join([words[i] for i in x]) for _, x in parts], pa.binary()))

        def out(block, rows, **cols):
            types = {"at": pa.int32(), "doc_id": id_type, "train": pa.bool_(), "flags": pa.binary(), "lens": pa.binary(), "ids": pa.binary(), "tokens": pa.int64(), "slot": pa.int32(), "lids": pa.binary(),
                     "toks": pa.binary(), "counts": pa.binary()}
            data = {"block": pa.array(np.full(rows, block, dtype=np.int64))}
            data |= {k: cols[k] if k in cols else pa.nulls(rows, t) for k, t in types.items()}
            return pa.RecordBatch.from_pydict(data)

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field("doc_id").type
            texts, flags, lo = b.column("text"), np.array([bool(x) for x in b.column("train").to_pylist()], dtype=bool), 0
            lens, flat = split_words(texts)
            ends = np.concatenate(([0], np.cumsum(lens)))
            for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                size += n
                if size >= block_bytes or i + 1 == len(texts):
                    many, own = i + 1 - lo, lens[lo:i + 1] + 1
                    coded = flat.slice(ends[lo], ends[i + 1] - ends[lo]).dictionary_encode()
                    known = [vocabulary[w] for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
                    ids = np.full(own.sum(), vocabulary[END])
                    inner = np.ones(len(ids), dtype=bool)
                    inner[np.cumsum(own) - 1] = False
                    ids[inner] = np.array(known, dtype=np.int64)[coded.indices.to_numpy()]
                    learnt = ids[np.repeat(flags[lo:i + 1], own)]
                    counts.append(np.bincount(learnt, minlength=0))
                    yield out(block, many, at=pa.array(np.arange(at, at + many, dtype=np.int32)),
                              doc_id=b.column("doc_id").slice(lo, many), train=b.column("train").slice(lo, many))
                    piece = {"flags": flags[lo:i + 1].astype(np.int64), "lens": own, "ids": ids}
                    yield out(block, 1, at=pa.array([at], pa.int32()), tokens=pa.array([len(ids)]), **{k: pa.array([pack(x)], pa.binary()) for k, x in piece.items()})
                    at += many
                    lo = i + 1
                    if size >= block_bytes:
                        yield from close()
        if vocabulary:
            yield from close()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", train.alias("train"), "text")
    return stage(map_arrow(rows, run, f"block long, at int, doc_id {id_type}, train boolean, flags binary, lens binary, ids binary, tokens long, slot int, lids binary, toks binary, counts binary"), "blocks")


#: what a block is told: its words (``d`` 0: a their ids in the block, b their
#: numbers, c their training counts) and, by depth and bucket, of each context it
#: asked for a four times what its stored symbols keep (0: no node), and b the
#: count of each pair
ANSWER_SCHEMA = "block long, d int, bucket int, a binary, b binary, c binary, found long, total long"


def _number(words: pd.DataFrame) -> pd.DataFrame:
    """Counts and numbers of the words of one slot (numbers grow as counts
    fall); one row more (block -1) has the words seen in training and their sum."""
    known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    index = []
    for t in words["toks"]:
        t = t.split(b"\n")
        index.append(np.fromiter(map(known.__getitem__, t), dtype=np.int64, count=len(t)))
    counts = np.zeros(len(known), dtype=np.int64)
    for i, n in zip(index, words["counts"], strict=True):
        counts[i] += unpack(n)                   # a block has a word once
    number = np.empty(len(known), dtype=np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(len(known)) * SLOTS + int(words["slot"].iloc[0])
    rows = [(b, 0, 0, lids, pack(number[i]), pack(counts[i]), 0, 0) for b, lids, i in zip(words["block"], words["lids"], index, strict=True)]
    rows.append((-1, 0, 0, None, None, None, int((counts > 0).sum()), int(counts.sum())))
    return pd.DataFrame(rows, columns=["block", "d", "bucket", "a", "b", "c", "found", "total"])


def distinct_keys(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (0 to ``bound``), the first place of each, and the
    index of each key in them."""
    bits = len(key).bit_length()
    if bound.bit_length() + bits < 64:           # keys and places in one word sort much faster
        order = np.sort((key << bits) | np.arange(len(key)))
        key = order >> bits
        order &= (1 << bits) - 1
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    back = np.empty(len(key), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return key[new], order[new], back


def escape_mass(kept, total):
    """What a context leaves to its parent, of ``total`` occurrences."""
    return 1 - kept / total


def deeper(escape, above, seen, total, gamma: float):
    """Probability at a node of a symbol ``seen`` so often after it."""
    return escape * above + np.where((seen > 1) & (seen >= gamma * total), (seen - DISCOUNT) / total, 0.0)


class Level:
    """A block's candidates of one depth and its (context, symbol) pairs that
    can be stored, dealt over buckets. ``where``, ``own``: positions after a
    candidate and its index; ``ctx``, ``total``: a candidate's code and count;
    ``at``, ``back``: positions of pairs and the index of the pair; ``o``,
    ``lid``, ``first``: a pair's candidate, symbol and one of its positions."""

    def __init__(self, b: Block | Rest, d: int, where, own, ctx, count, least: float, buckets: int, hot: int):
        # a context occurs as often as its newest word follows the others
        ok = (b.at[where] >= d) & (count[where - 1] >= least)
        self.where, words = where[ok], len(b.g)
        key, at, self.own = distinct_keys(own[ok] * words + b.ids[self.where - d], len(ctx) * words)
        self.parent = key // words
        self.ctx = extend(ctx[self.parent], b.h[key % words], d)
        self.total = count[self.where[at] - 1]
        # a symbol that follows a context n times follows its parent n times
        ok = count[self.where] >= 2
        self.at = self.where[ok]
        pair, first, self.back = distinct_keys(self.own[ok] * words + b.ids[self.at], len(key) * words)
        self.first, self.o, self.lid = self.at[first], pair // words, pair % words
        n, many = len(self.ctx), U64(buckets)
        home = (self.ctx % many).astype(np.int64)
        bucket = home[self.o]
        if (self.total >= hot).any():
            parts = np.where(self.total >= hot, self.total // hot + 1, 0)
            home = np.where(parts > 0, self.spread(self.ctx, U64(0), many), home)
            bucket = home[self.o]
            k = np.flatnonzero(parts[self.o])
            bucket[k] = self.spread(self.ctx[self.o[k]], b.h[self.lid[k]] % parts[self.o[k]].astype(np.uint64), many)
            mine = np.unique(np.concatenate((home * n + np.arange(n), bucket[k] * n + self.o[k])))
        else:
            mine = np.sort(home * n + np.arange(n))
        self.mine, self.listed, self.buckets = mine, mine % max(n, 1), mine // max(n, 1)
        self.order = np.argsort(bucket.astype(np.int16) if 2 * buckets < 1 << 15 else bucket, kind="stable")
        self.bucket = bucket[self.order]

    @staticmethod
    def spread(ctx, part, many) -> np.ndarray:
        return (many + mix64(ctx + part) % many).astype(np.int64)

    def portions(self):
        """Each bucket with the slices of its contexts and of its pairs."""
        names, lo = np.unique(self.buckets, return_index=True)
        hi = np.append(lo[1:], len(self.buckets))
        p = np.searchsorted(self.bucket, names), np.searchsorted(self.bucket, names, side="right")
        for k, name in enumerate(names):
            yield int(name), slice(lo[k], hi[k]), slice(p[0][k], p[1][k])

    def heard(self, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Escape masses of the candidates (nan: no node), counts of the pairs."""
        escape, n = np.full(len(self.ctx), np.nan), np.zeros(len(self.o), dtype=np.int64)
        said = {k: (a, b) for k, a, b in zip(told["bucket"], told["a"], told["b"], strict=True)}
        kept = np.zeros(len(self.ctx), dtype=np.int64)
        for name, contexts, pairs in self.portions():
            a, b = said[name]
            kept[self.listed[contexts]] = unpack(a)
            n[self.order[pairs]] = unpack(b)
        node = kept > 0
        escape[node] = escape_mass(kept[node] / 4, self.total[node])
        self.kept = kept
        return escape, n


class Block:
    """The symbols of one block, flat, with the contexts before them."""

    def __init__(self, texts: pd.DataFrame, vocabulary: pd.DataFrame):
        texts = texts.sort_values("at")
        self.ids, self.lens, flags = (np.concatenate([unpack(x) for x in texts[c]]) for c in ("ids", "lens", "flags"))
        self.train = np.repeat(flags > 0, self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        lid = np.concatenate([np.cumsum(unpack(x)) for x in vocabulary["a"]])
        self.g, self.c = np.zeros(len(lid), dtype=np.int64), np.zeros(len(lid), dtype=np.int64)
        self.g[lid] = np.concatenate([unpack(x) for x in vocabulary["b"]])
        self.c[lid] = np.concatenate([unpack(x) for x in vocabulary["c"]])
        self.h = mix64(self.g.view(np.uint64))
        self.at = np.arange(len(self.ids)) - np.repeat(self.first, self.lens)
        self.last: Level | None = None           # the deepest level walked

    def walk(self, told: pd.DataFrame, root: np.ndarray, depth: int, rule: tuple):
        """Each symbol's probability at its deepest node of at most ``depth``
        words; the positions after contexts of ``depth`` words that are nodes,
        their indices in the codes that come next; and how often each symbol follows its context of ``depth`` words
        (0 where that is no candidate, or no node and less than a candidate)."""
        least, _, buckets, hot = rule
        p, count = root[self.ids], self.c[self.ids]
        where, own, ctx = np.arange(len(self.ids)), np.zeros(len(self.ids), dtype=np.int64), np.zeros(1, dtype=np.uint64)
        for d in range(1, depth + 1):
            x = Level(self, d, where, own, ctx, count, least, buckets, hot)
            where, own, ctx, count = deepen(x, told[told["d"] == d], p, rule)
            self.last = x
        return p, where, own, ctx, count


def deepen(x: Level, told: pd.DataFrame, p: np.ndarray, rule: tuple):
    """One depth of ``Block.walk``; ``p`` is brought up to it in place."""
    escape, n = x.heard(told)
    count = np.zeros(len(p), dtype=np.int64)
    count[x.at] = n[x.back]
    ok = ~np.isnan(escape[x.own])
    where, own = x.where[ok], x.own[ok]
    seen, total = count[where], x.total[own]
    p[where] = deeper(escape[own], p[where], seen, total, rule[1])
    return where, own, x.ctx, count


REST_SCHEMA = "block long, " + ", ".join(f"{c} binary" for c in ("lens", "ids", "g", "flags", "places", "own", "ctx", "counts", "above"))
REST_COLUMNS = [c.split()[0] for c in REST_SCHEMA.split(", ")]


class Rest:
    """What a block carries after a depth: the positions whose contexts can be
    candidates one word longer, and the words around them. A longer context of
    such a position lies within its own and its neighbour's, so that all words
    that later depths ask for are here. Words and contexts keep their order, so
    that buckets are asked in the order in which ``Block.walk`` listens."""

    def __init__(self, row: pd.Series, depth: int, rule: tuple):
        """The state after ``depth`` words: ``where``, ``own``, ``ctx``,
        ``count`` as ``Block.walk`` gives them, ``next`` the level to ask for, ``p`` at its pairs."""
        least, _, buckets, hot = rule
        lens, self.ids, self.g, flags, count = (unpack(row[c]) for c in ("lens", "ids", "g", "flags", "counts"))
        self.train, self.h = flags > 0, mix64(self.g.view(np.uint64))
        self.at = np.arange(len(self.ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.next = Level(self, depth + 1, np.cumsum(unpack(row["places"])), unpack(row["own"]), unpack(row["ctx"], np.uint64), count, least, buckets, hot)
        self.p = np.zeros(len(self.ids))
        self.p[self.next.at] = unpack(row["above"], np.float64)[self.next.back]

    @staticmethod
    def of(block: int, b: Block | Rest, depth: int, p, where, own, ctx, count, rule: tuple) -> list[tuple]:
        """The row of what is left of ``b`` after ``depth`` words, if anything."""
        least, _, buckets, hot = rule
        x = Level(b, depth + 1, where, own, ctx, count, least, buckets, hot)
        ok = (b.at[where] > depth) & (count[where - 1] >= least)      # as the level chose
        own = own[ok]
        if not len(x.where):
            return []
        edges = np.zeros(len(b.ids) + 1, dtype=np.int64)
        edges[x.where - depth - 1] += 1
        edges[x.where + 1] -= 1
        at = np.flatnonzero(np.cumsum(edges[:-1]))
        new = b.at[at] == 0
        new[0] = True
        new[1:] |= np.diff(at) > 1
        lids, _, ids = distinct_keys(b.ids[at], len(b.g))
        codes, _, own = distinct_keys(own, len(ctx))
        columns = (np.diff(np.append(np.flatnonzero(new), len(at))), ids, b.g[lids], b.train[at].astype(np.int64),
                   np.diff(np.searchsorted(at, x.where), prepend=0), own, ctx[codes], count[at], p[x.first])
        return [(block, *map(pack, columns))]


def extend(code, word, d: int):
    """Code of a context one older word longer; at depth 1 the word's hash."""
    return word if d == 1 else mix64(code * U64(3) + word + U64(d))


def root_probability(c: np.ndarray, n_train: int, distinct: int) -> np.ndarray:
    return (c + ALPHA) / (n_train + ALPHA * (distinct + 1))


GRAM_COLUMNS = ["block", "bucket", "ctx", "total", "pairs", "sym", "n", "above", "roots", "kept", "totals"]
GRAM_SCHEMA = "block long, bucket int, " + ", ".join(f"{c} binary" for c in GRAM_COLUMNS[2:])


def asked(block: int, b: Block | Rest, x: Level, above: np.ndarray, parent: Level | None = None) -> pd.DataFrame:
    """By bucket, the block's distinct candidates of one depth (code, count,
    pairs) and its (context, symbol) pairs that can be stored: the symbol's
    number, count in the block, and probability at the context's parent (depth
    1: count, from which the root's probability follows; after texts at depth 2,
    with ``parent``: count after the parent, and further whole numbers from which
    it follows, the count of each distinct symbol by its number and what each
    context's parent keeps and its occurrences)."""
    n = np.bincount(x.back, weights=b.train[x.at], minlength=len(x.o)).astype(np.int64)
    listed = np.searchsorted(x.mine, x.bucket * len(x.ctx) + x.o[x.order])
    pairs = np.bincount(listed, minlength=len(x.mine))
    rows = []
    for name, c, k in x.portions():
        i, k = x.listed[c], x.order[k]
        sym, further = b.g[x.lid[k]], [None] * 3
        if parent is not None:
            first = np.unique(sym, return_index=True)[1]
            further = [pack(y) for y in (b.c[x.lid[k]][first], parent.kept[x.parent[i]], parent.total[x.parent[i]])]
        rows.append((block, name, pack(x.ctx[i]), pack(x.total[i]), pack(pairs[c]), pack(sym), pack(n[k]), pack(above[k]), *further))
    return pd.DataFrame(rows, columns=GRAM_COLUMNS)


def _grams(depth: int, n_train: int, distinct: int, rule: tuple):
    """What a block asks at a depth, from its texts."""
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        vocabulary = answers[answers["d"] == 0]
        if not len(texts) or not len(vocabulary):
            return pd.DataFrame(columns=GRAM_COLUMNS)
        least, _, buckets, hot = rule
        b = Block(texts, vocabulary)
        p, where, own, ctx, count = b.walk(answers, root_probability(b.c, n_train, distinct), depth - 1, rule)
        x = Level(b, depth, where, own, ctx, count, least, buckets, hot)
        above = b.c[x.lid] if depth == 1 else count[x.first] if depth == 2 else p[x.first]
        return asked(int(texts["block"].iloc[0]), b, x, above, b.last if depth == 2 else None)

    return run


def _grams_of_rest(depth: int, rule: tuple):
    """The same from what the block carries of one word less."""
    def run(batches):
        for rest in batches:
            for _, row in rest.iterrows():
                b = Rest(row, depth - 1, rule)
                yield asked(int(row["block"]), b, b.next, b.p[b.next.first])

    return run


def _carry(depth: int, n_train: int, distinct: int, rule: tuple):
    """What a block carries after a depth, from its texts and all answers."""
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, vocabulary = [], answers[answers["d"] == 0]
        if len(texts) and len(vocabulary):
            b = Block(texts, vocabulary)
            rows = Rest.of(int(texts["block"].iloc[0]), b, depth, *b.walk(answers, root_probability(b.c, n_train, distinct), depth, rule), rule)
        return pd.DataFrame(rows, columns=REST_COLUMNS)

    return run


def _carry_on(depth: int, rule: tuple):
    """The same from what it carried of one word less and the answers since."""
    def run(rest: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(rest):
            b = Rest(rest.iloc[0], depth - 1, rule)
            rows = Rest.of(int(rest["block"].iloc[0]), b, depth, b.p, *deepen(b.next, answers, b.p, rule), rule)
        return pd.DataFrame(rows, columns=REST_COLUMNS)

    return run


class Bucket:
    """The candidates and pairs of one bucket, counted over all blocks."""

    def __init__(self, asked: pd.DataFrame, depth: int, n_train: int, distinct: int, gamma: float):
        def column(name, dtype=np.int64):
            return [unpack(x, dtype) for x in asked[name]]

        ctx, sym, pairs = column("ctx", np.uint64), column("sym"), np.concatenate(column("pairs"))
        self.blocks, self.bucket = asked["block"].tolist(), int(asked["bucket"].iloc[0])
        self.contexts, self.pairs = np.cumsum([0, *map(len, ctx)]), np.cumsum([0, *map(len, sym)])
        self.ctx, at, self.listed = np.unique(np.concatenate(ctx), return_index=True, return_inverse=True)
        self.total = np.concatenate(column("total"))[at]
        own, sym = np.repeat(self.listed, pairs), np.concatenate(sym)
        most = int(sym.max(initial=0)) + 1
        if most * max(len(self.ctx), 1) >= 1 << 63:
            sym = distinct_keys(sym, most)[2]
            most = int(sym.max()) + 1
        key, first, self.back = distinct_keys(own * most + sym, len(self.ctx) * most)
        self.o = key // most
        self.n = np.bincount(self.back, weights=np.concatenate(column("n")), minlength=len(key)).astype(np.int64)
        # the symbols that can be stored
        self.k = np.flatnonzero((self.n > 1) & (self.n >= gamma * self.total[self.o]))
        first, whole = first[self.k], depth == 1 or asked["roots"].notna().all()
        above = np.concatenate(column("above", np.int64 if whole else np.float64))[first]
        if depth == 1:
            above = root_probability(above, n_train, distinct)
        elif whole:
            kept, total = (np.repeat(np.concatenate(column(c)), pairs)[first] for c in ("kept", "totals"))
            c = np.concatenate([c[np.unique(y, return_inverse=True)[1]] for c, y in zip(column("roots"), column("sym"), strict=True)])
            above = deeper(escape_mass(kept / 4, total), root_probability(c[first], n_train, distinct), above, total, gamma)
        self.above = above

    def over(self, value: np.ndarray) -> np.ndarray:
        """Sum by candidate of a value of the symbols that can be stored."""
        return np.bincount(self.o[self.k], weights=value, minlength=len(self.ctx))

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """By candidate, what the symbols that can be stored keep and their number."""
        n = self.n[self.k]
        return self.over(n - DISCOUNT), self.over(np.ones(len(n)))

    def told(self, escape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By candidate, the sums of p log(p / above) and of p."""
        o = self.o[self.k]
        p = (self.n[self.k] - DISCOUNT) / self.total[o] + escape[o] * self.above
        return self.over(p * np.log(p / self.above)), self.over(p)

    def replies(self, d: int, kept, symbols, gain, mass, least: float, divergence: float) -> list[tuple]:
        escape = escape_mass(kept, self.total)
        # symbols that are not stored contribute log(escape) each
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = gain + (1 - mass) * np.log(escape)
        node = (symbols > 0) & (escape > 0) & (kl >= divergence)
        kept = np.where(node, 4 * kept, 0).astype(np.int64)[self.listed]
        n = np.where((self.n > 1) & (node[self.o] | (self.n >= least)), self.n, 0)
        found = int(node.sum())
        return [(block, d, self.bucket, pack(kept[self.contexts[i]:self.contexts[i + 1]]),
                 pack(n[self.back[self.pairs[i]:self.pairs[i + 1]]]), None, found, 0) for i, block in enumerate(self.blocks)]


#: what buckets say: answers, and of contexts dealt over several buckets the
#: questions again and, by context, two sums of this bucket
COUNT_SCHEMA = (f"{ANSWER_SCHEMA}, code long, x double, y double, "
                "ctx binary, times binary, " + ", ".join(f"{c} binary" for c in GRAM_COLUMNS[4:]))
COUNT_COLUMNS = [c.split()[0] for c in COUNT_SCHEMA.split(", ")]


def grow(grams: DataFrame, d: int, n_train: int, distinct: int, divergence: float, rule: tuple) -> DataFrame:
    """From what the blocks ask at one depth, what they are told, staged."""
    least, gamma, buckets, _ = rule

    def sums(b: Bucket, x, y) -> list[tuple]:
        return [(None, d, b.bucket, *[None] * 5, c, u, v, *[None] * 9) for c, u, v in
                zip(b.ctx.view(np.int64).tolist(), x.tolist(), y.tolist(), strict=True)]

    def count(asked: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(asked, d, n_train, distinct, gamma)
        kept, symbols = b.stored()
        if b.bucket < buckets:
            rows = [(*r, *[None] * 12) for r in b.replies(d, kept, symbols, *b.told(escape_mass(kept, b.total)), least, divergence)]
        else:
            rows = sums(b, kept, symbols)
            again = asked[GRAM_COLUMNS]
            rows += [(r[0], d, r[1], *[None] * 8, *r[2:]) for r in again.itertuples(index=False)]
        return pd.DataFrame(rows, columns=COUNT_COLUMNS, dtype=object)      # ids beside nulls stay whole

    said = stage(grams.groupBy("bucket").applyInPandas(count, COUNT_SCHEMA), "counts")
    answers = said.where("a is not null").select("block", "d", "bucket", "a", "b", "c", "found", "total")
    asked = said.where("ctx is not null").select("block", "bucket", "ctx", F.col("times").alias("total"), *GRAM_COLUMNS[4:])
    first = said.where("code is not null").select("bucket", "code", "x", "y")
    if first.isEmpty():
        return answers
    same = Window.partitionBy("code")
    first = first.select("bucket", "code", F.sum("x").over(same).alias("x"), F.sum("y").over(same).alias("y"))

    def known(b: Bucket, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(b.ctx, rows["code"].to_numpy(dtype=np.int64).view(np.uint64))
        x, y = np.empty(len(b.ctx)), np.empty(len(b.ctx))
        x[at], y[at] = rows["x"].to_numpy(), rows["y"].to_numpy()
        return x, y

    def diverge(asked: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(asked, d, n_train, distinct, gamma)
        rows = sums(b, *b.told(escape_mass(known(b, first)[0], b.total)))
        return pd.DataFrame([(r[2], *r[8:11]) for r in rows], columns=["bucket", "code", "x", "y"])

    def reply(asked: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(asked, d, n_train, distinct, gamma)
        rows = b.replies(d, *known(b, both[both["second"] == 0]), *known(b, both[both["second"] == 1]), least, divergence)
        return pd.DataFrame(rows, columns=COUNT_COLUMNS[:8])

    # one job: both cogroups read the questions from one shuffle
    second = asked.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInPandas(diverge, "bucket int, code long, x double, y double")
    gained = second.select("bucket", "code", F.sum("x").over(same).alias("x"), F.sum("y").over(same).alias("y"))
    both = first.withColumn("second", F.lit(0)).union(gained.withColumn("second", F.lit(1)))
    answers = stage(answers.union(asked.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInPandas(reply, ANSWER_SCHEMA)), "replies")
    unstage(said)
    return answers


def _score(depth: int, n_train: int, distinct: int, rule: tuple):
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        vocabulary = answers[answers["d"] == 0]
        if not len(texts) or not len(vocabulary):
            return pd.DataFrame(columns=["block", "at", "n_tokens", "n_known", "base_score", "score"])
        b = Block(texts, vocabulary)
        root = root_probability(b.c, n_train, distinct)
        p = b.walk(answers, root, depth, rule)[0]
        return pd.DataFrame({
            "block": int(texts["block"].iloc[0]), "at": np.arange(len(b.lens)), "n_tokens": b.lens,
            "n_known": np.add.reduceat((b.c[b.ids] > 0).astype(np.int64), b.first),
            "base_score": np.add.reduceat(np.log10(root[b.ids]), b.first), "score": np.add.reduceat(np.log10(p), b.first)})

    return run


def score(docs: DataFrame, train: Column, p_min: float = P_MIN, depth: int | None = DEPTH, block_bytes: int = BLOCK_BYTES,
          divergence: float = DIVERGENCE, gamma: float = GAMMA, min_count: int = MIN_COUNT, bucket_tokens: int = BUCKET_TOKENS,
          hot: int = HOT) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    blocks = code_blocks(docs, train, block_bytes)
    rows = blocks.where("at is not null and ids is null").select("block", "at", "doc_id", "train")
    texts = blocks.where("ids is not null").select("block", "at", "flags", "lens", "ids")
    words = blocks.where("slot is not null").select("block", "slot", "lids", "toks", "counts")
    told = stage(words.groupBy("slot").applyInPandas(_number, ANSWER_SCHEMA), "vocabulary")
    distinct, n_train = (x or 0 for x in told.where("block = -1").agg(F.sum("found"), F.sum("total")).first())
    n_all = blocks.agg(F.sum("tokens")).first()[0] or 0
    reclaim(spark)
    rule = (max(2.0, min_count, p_min * n_train), gamma, blocks_for(n_all, bucket_tokens), hot)
    # what the blocks are told: their words (d = 0) and, by depth, the answers of the buckets
    answers = told.where("block <> -1")
    d, rest = 0, None
    while depth is None or d < depth:
        d += 1
        if rest is None:
            grams = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_grams(d, n_train, distinct, rule), GRAM_SCHEMA)
        else:
            grams = rest.mapInPandas(_grams_of_rest(d, rule), GRAM_SCHEMA)
        reply = grow(grams, d, n_train, distinct, divergence, rule)
        reclaim(spark)
        if not (reply.agg(F.max("found")).first()[0] or 0):
            unstage(reply)
            d -= 1
            break
        answers = answers.union(reply)
        if d >= CARRY and d != depth:
            if rest is None:
                left = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_carry(d, n_train, distinct, rule), REST_SCHEMA)
            else:
                left = rest.groupBy("block").cogroup(reply.groupBy("block")).applyInPandas(_carry_on(d, rule), REST_SCHEMA)
            before, rest = rest, stage(left, "rest")
            if before is not None:
                unstage(before)
            reclaim(spark)
    if rest is not None:
        unstage(rest)
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(d, n_train, distinct, rule), "block long, at int, n_tokens long, n_known long, base_score double, score double")
    return rows.join(scored, ["block", "at"]).select(
        "doc_id", (~F.coalesce("train", F.lit(False))).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")
