"""Near-duplicate classes by BagMinHash (operator 10).

A document is the multiset of its five-word shingles (words: lower-cased A-Z,
cut at ASCII white space; a text of fewer words is one shingle). Its signature
has one register per Poisson process: every shingle throws points (time,
register, height) in unit and then doubling shells of weight; a point counts
if its height is below the shingle's multiplicity, and each register keeps the
point of least time. Two registers agree with the weighted Jaccard likeness of
the multisets. Points are only drawn up to the time by which all registers are
filled, so the work per document is nearly independent of its length.

Equal texts are one node. Signatures fall into bands; a band shared by several
nodes links each of them to the bucket's most connected node and to its
neighbours in a random order. Every link is then verified on the exact
multisets (``threshold``), and connected components of the verified links are
the classes. The two rounds join nearly all of a class with few links; in the
buckets that still hold more than one component, every pair of two components
is then compared, so that all pairs that share a band are decided.

Scale: texts are read for signatures without a shuffle; a hot group of equal
texts collapses by map-side aggregation; buckets are only aggregated, joined
and cut into salted parts before ordering; links, components and signatures
stay in tables. Components take a logarithmic number of star contractions. Of a
bucket that still holds several components, the nodes outside the largest are
compared with all, inside tasks, without a row for each pair: both sides are
dealt into blocks of about ``BLOCK_BYTES`` of multisets, and a task decides
pairs of blocks. Rows and bytes are linear in the bucket while those outside
fill one block; beyond that, bytes and time grow with the product of the two
sides: it is the price of deciding all unlike pairs of a family.

Edge cases: null and empty texts are equal texts (one class); a null id is
carried, and the class id is the least non-null id of the class; repeated rows
share their class; an empty table gives an empty result; other columns are
ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, WordHashes, binary_column, map_arrow, mix64, private, rolling, stage, text_or_empty, unstage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: nodes of a bucket that are ordered together; larger buckets are salted
BUCKET_PART = 500
NEIGHBOURS = 2
#: multisets of a block of a bucket
BLOCK_BYTES = 4 << 20


def text_key(c: str = "text") -> Column:
    """Identity of a text: its 128-bit digest."""
    return F.unhex(F.md5(text_or_empty(c).cast("binary")))


def shingles(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, multiplicities)."""
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.unique(rolling(hashes.of(words), min(SHINGLE, len(words))), return_counts=True)


# ------------------------------------------------------------------ signatures


def _points(h, w, doc, horizon, registers):
    """Points (register slot, time, code) of all elements up to the horizons."""
    slot, time, code = [], [], []
    lo, size = np.zeros(len(h)), np.ones(len(h))
    shell = 0
    while len(h):
        seed = mix64(h + U64(shell))
        t, alive, rnd = np.zeros(len(h)), np.arange(len(h)), 0
        while len(alive):
            a = mix64(seed[alive] + U64(rnd * 0xD1B54A32D192ED03 % 2 ** 64))
            gap = -np.log(((a >> U64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / size[alive]
            t[alive] += gap
            alive, a = alive[t[alive] <= horizon[doc[alive]]], a[t[alive] <= horizon[doc[alive]]]
            b = mix64(a)
            use = alive
            if shell:                    # the point's height within the shell
                y = lo[alive] + size[alive] * ((mix64(b) >> U64(11)).astype(np.float64) / 2.0 ** 53)
                ok = y < w[alive]
                use, b = alive[ok], b[ok]
            slot.append(doc[use] * registers + (b % U64(registers)).astype(np.int64))
            time.append(t[use])
            code.append(b)
            rnd += 1
        lo, size = lo + size, np.where(lo + size > 1, 2 * size, size)
        more = lo < w
        h, w, doc, lo, size = h[more], w[more], doc[more], lo[more], size[more]
        shell += 1
    return np.concatenate(slot), np.concatenate(time), np.concatenate(code)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """(documents, registers) codes of the least points; bags must not be empty."""
    out = np.zeros((len(bags), registers), dtype=np.uint64)
    todo = np.arange(len(bags))
    slack = 4.0
    while len(todo):
        h = np.concatenate([bags[i][0] for i in todo])
        w = np.concatenate([bags[i][1] for i in todo])
        doc = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        total = np.array([bags[i][1].sum() for i in todo], dtype=np.float64)
        horizon = registers * (np.log(registers) + slack) / total
        slot, time, code = _points(h, w, doc, horizon, registers)
        least = np.full(len(todo) * registers, np.inf)
        np.minimum.at(least, slot, time)
        first = time == least[slot]
        sig = np.zeros(len(todo) * registers, dtype=np.uint64)
        sig[slot[first]] = code[first]
        full = np.isfinite(least).reshape(len(todo), registers).all(axis=1)
        out[todo[full]] = sig.reshape(len(todo), registers)[full]
        todo = todo[~full]
        slack *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) 64-bit bucket ids."""
    rows = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        out = mix64(out ^ rows[:, :, r])
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text and its band hashes (none without words)."""
    few = 1000

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = binary_column(b, "text")
            bands: list = [None] * len(texts)
            for lo in range(0, len(texts), few):
                bags, at = [], []
                for i in range(lo, min(lo + few, len(texts))):
                    bag = shingles((texts[i] or b"").lower().split(), hashes)
                    if len(bag[0]):
                        bags.append(bag)
                        at.append(i)
                if bags:
                    for i, x in zip(at, band_hashes(signatures(bags)).view(np.int64)):
                        bands[i] = x
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": b.column("key"),
                                              "bands": pa.array(bands, pa.list_(pa.int64()))})

    rows = docs.select("doc_id", text_key().alias("key"), "text")
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, bands array<long>")


# ------------------------------------------------------------------ candidates


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, size) of the bands that several nodes share."""
    rows = nodes.where(F.col("bands").isNotNull()).select("key", F.explode("bands").alias("band"))
    # written: with plain shuffles on both sides, Spark splits a hot band's join
    sizes = stage(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    return rows.join(sizes, "band")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def central_links(shared: DataFrame) -> DataFrame:
    """Distinct (a, b): each node of a bucket with the bucket's node that
    shares the most and largest buckets."""
    score = shared.groupBy("key").agg(F.sum(F.log("size")).alias("score"))
    scored = shared.join(score, "key")
    centre = stage(scored.groupBy("band").agg(F.max_by("key", F.struct("score", "key")).alias("centre")), "centres")
    return (shared.join(centre, "band").where(F.col("key") != F.col("centre"))
            .select(*_ordered(F.col("key"), F.col("centre"))).distinct())


def neighbour_links(shared: DataFrame) -> DataFrame:
    """Distinct (a, b): each node with the next ones of its bucket in a random
    order that differs between buckets."""
    part = F.pmod(F.xxhash64("key", "band", F.lit(1)), F.ceil(F.col("size") / BUCKET_PART))
    w = Window.partitionBy("band", "_part").orderBy(F.xxhash64("key", "band"), "key")
    near = F.array(*[F.lead("key", k).over(w) for k in range(1, NEIGHBOURS + 1)])
    return (shared.withColumn("_part", part).select("key", near.alias("_near"))
            .select("key", F.explode("_near").alias("other")).where("other is not null and other != key")
            .select(*_ordered(F.col("key"), F.col("other"))).distinct())


# ---------------------------------------------------------------- verification


def bags_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, h, w): shingle hashes and multiplicities of the wanted (doc_id,
    key) rows."""
    texts = (docs.select("doc_id", text_key().alias("key"), "text")
             .join(wanted.withColumnsRenamed({"doc_id": "_id", "key": "_key"}),
                   F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi"))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            h, w = [], []
            for t in binary_column(b, "text"):
                x, n = shingles((t or b"").lower().split(), hashes)
                h.append(x.tobytes())
                w.append(n.astype(np.uint32).tobytes() if len(n) and n.max() > 1 else None)
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "h": pa.array(h, pa.binary()),
                                              "w": pa.array(w, pa.binary())})

    return map_arrow(texts, run, "key binary, h binary, w binary")


def likeness(ha: np.ndarray, wa, hb: np.ndarray, wb) -> float:
    """Weighted Jaccard of two multisets (sorted hashes, multiplicities)."""
    total = (len(ha) if wa is None else int(wa.sum())) + (len(hb) if wb is None else int(wb.sum()))
    if not total:
        return 0.0
    i = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
    same = hb[i] == ha if len(hb) else np.zeros(len(ha), dtype=bool)
    one = np.ones(1, dtype=np.int64)
    x = wa[same] if wa is not None else one
    y = wb[i[same]] if wb is not None else one
    common = int(np.minimum(*np.broadcast_arrays(x, y)).sum()) if wa is not None or wb is not None else int(same.sum())
    return common / (total - common)


def verified(links: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links whose multisets are alike enough."""
    side = lambda c: bags.select(F.col("key").alias(c), F.col("h").alias(f"h{c}"), F.col("w").alias(f"w{c}"))
    both = links.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        def arr(x, t):
            return None if x is None else np.frombuffer(x, dtype=t)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("ha", "wa", "hb", "wb")]
            ok = [likeness(arr(p, np.uint64), arr(q, np.uint32), arr(r, np.uint64), arr(s, np.uint32)) >= threshold
                  for p, q, r, s in zip(*cols)]
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, "a binary, b binary")


# ------------------------------------------------------- pairs not yet joined


def open_buckets(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(band, key, root, major): the buckets that hold several components, with
    the largest one."""
    rows = (shared.select("band", "key").join(comp.select(F.col("node").alias("key"), "root"), "key", "left")
            .withColumn("root", F.coalesce("root", "key")))
    parts = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    # written, so that both sides of the join are plain shuffles
    mixed = stage(parts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"), "mixed")
    return rows.join(mixed, "band")


def elements(h: np.ndarray, w) -> np.ndarray:
    """A multiset as a set: the k-th occurrence of a hash is an element."""
    if w is None:
        return h
    ends = np.cumsum(w, dtype=np.int64)
    nth = np.arange(ends[-1]) - np.repeat(ends - w, w)
    rows = np.repeat(h, w)
    return np.where(nth == 0, rows, mix64(rows + nth.astype(np.uint64) * U64(0xD1B54A32D192ED03)))


def alike(left: list[int], right: list[int], sets: list[np.ndarray], root: np.ndarray, bands: np.ndarray, band: int,
          threshold: float, order: np.ndarray, twice: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a left and a right set of different components that are alike
    enough; a pair that shares several bands is compared in the first. A right
    set that is on the left of another comparison (``twice``) meets only left
    sets before it in ``order``."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(ids, np.cumsum(sizes)[:-1])
    post = np.concatenate([of[j] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    at_post = np.argsort(post, kind="stable")
    owner, start = owner[at_post], np.concatenate(([0], np.cumsum(np.bincount(post, minlength=int(ids.max()) + 1))))
    right_sizes, right_root, right_bands, right_order = sizes[right], root[right], bands[right], np.where(twice[right], order[right], len(sets))
    out = []
    for i in left:
        ok = ((right_root != root[i]) & (right_order > order[i])
              & (np.minimum(right_sizes, sizes[i]) >= threshold * np.maximum(right_sizes, sizes[i]) - 1e-6))
        if ok.any():
            shared = right_bands[ok] == bands[i]
            ok[ok] = bands[i][shared.argmax(axis=1)] == band
        if not ok.any():
            continue
        lo, n = start[of[i]], start[of[i] + 1] - start[of[i]]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        ok &= common / (right_sizes + sizes[i] - common) >= threshold
        out += [(i, right[j]) for j in np.flatnonzero(ok)]
    return out


def dealt(opened: DataFrame, bags: DataFrame) -> DataFrame:
    """(band, p, q, key, root, left, minor): the nodes outside a bucket's largest
    component, in blocks p, on the left; all nodes of the bucket, in blocks q, on the
    right. A bucket whose multisets fill one block of each is one group, and a
    node is in it once or twice."""
    size = F.octet_length("h") + F.coalesce(F.octet_length("w"), F.lit(0))
    minor = F.col("root") != F.col("major")
    rows = opened.select("band", "key", "root", minor.alias("minor"))
    blocks = stage(rows.join(bags.select("key", size.alias("size")), "key").groupBy("band").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("all"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("minor"), F.col("size"))) / BLOCK_BYTES)).alias("few")), "blocks")
    rows = rows.join(blocks, "band")
    p, q = F.pmod(F.xxhash64("key", "band", F.lit(2)), F.col("few")), F.pmod(F.xxhash64("key", "band", F.lit(3)), F.col("all"))

    def upto(n):
        return F.sequence(F.lit(0).cast("long"), n - 1)

    lefts = F.transform(upto(F.col("all")), lambda i: F.struct(p.alias("p"), i.alias("q"), F.lit(True).alias("left")))
    rights = F.transform(upto(F.col("few")), lambda i: F.struct(i.alias("p"), q.alias("q"), F.lit(False).alias("left")))
    places = F.when(F.col("minor"), F.concat(lefts, rights)).otherwise(rights)
    return rows.select("band", "key", "root", "minor", F.explode(places).alias("at")).select("band", "at.p", "at.q", "at.left", "key", "root", "minor")


def block_links(opened: DataFrame, nodes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of different components of a bucket that are alike
    enough, compared inside tasks without a row for each pair."""
    rows = dealt(opened, bags).join(nodes.select("key", "bands"), "key").join(bags, "key")
    group = ["band", "p", "q"]

    def decided(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        left, right = [i for i, r in enumerate(rows) if r["left"]], [i for i, r in enumerate(rows) if not r["left"]]
        if not left or not right:
            return []
        sets = [elements(np.frombuffer(r["h"], dtype=np.uint64), None if r["w"] is None else np.frombuffer(r["w"], dtype=np.uint32)) for r in rows]
        numbers = {k: n for n, k in enumerate(sorted({r["key"] for r in rows}))}
        roots = {k: n for n, k in enumerate({r["root"] for r in rows})}
        pairs = alike(left, right, sets, np.array([roots[r["root"]] for r in rows]), np.array([r["bands"] for r in rows]), rows[0]["band"],
                      threshold, np.array([numbers[r["key"]] for r in rows]), np.array([r["minor"] for r in rows]))
        return [tuple(sorted((rows[i]["key"], rows[j]["key"]))) for i, j in pairs]

    def run(batches):
        def batch(pairs):
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})
        held, now = [], None                                   # the rows of one group
        for b in batches:
            for r in b.to_pylist():
                at = r["band"], r["p"], r["q"]
                if at != now and held:
                    yield batch(decided(held))
                    held = []
                now = at
                held.append(r)
        if held:
            yield batch(decided(held))

    return map_arrow(rows.repartition(*group).sortWithinPartitions(*group), run, "a binary, b binary")


# ------------------------------------------------------------------ components


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the component's
    least node. Alternating large-star and small-star contractions."""
    both = _ordered(F.col("a"), F.col("b"))
    edges = stage(links.where("a != b").select(*both).distinct()
                  .select(F.col("b").alias("u"), F.col("a").alias("v")), "edges")
    state = None
    while True:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u != v").distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        pulled = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(pulled.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(edges)
        unstage(large)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --------------------------------------------------------------------- classes


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) rows and (key, root, rep) of every distinct text."""
    signed = stage(sign(docs), "signatures")
    nodes = stage(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes")
    shared = stage(buckets(nodes), "buckets")
    members = shared.select("key").distinct()
    bags = stage(bags_of(docs, nodes.join(members, "key", "left_semi").select(F.col("rep").alias("doc_id"), "key")),
                 "bags")
    first = stage(verified(central_links(shared), bags, threshold), "links")
    comp = stage(components(first), "components")
    # neighbours that the central links have not joined yet
    at = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = (neighbour_links(shared).join(at("a"), "a", "left").join(at("b"), "b", "left")
             .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    second = verified(apart, bags, threshold)
    comp = stage(components(first.union(second)), "components")
    # what the two rounds left apart: every pair that shares a band
    opened = stage(open_buckets(shared, comp), "open")
    third = stage(block_links(opened, nodes, bags, threshold), "links")
    if not third.isEmpty():
        roots = (third.join(at("a"), "a", "left").join(at("b"), "b", "left")
                 .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
        merged = stage(components(roots), "components").select(F.col("node").alias("old"), F.col("root").alias("new"))
        alone = roots.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti")
        whole = comp.union(alone.select("node", F.col("node").alias("root")))
        comp = whole.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    of = (nodes.select("key", "rep").join(comp, F.col("key") == F.col("node"), "left")
          .select("key", "rep", F.coalesce("root", "key").alias("root")))
    return signed.select("doc_id", "key"), of


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (the class's least doc_id), and whether
    it is the one that stands for its class."""
    rows, of = _classes(docs, threshold)
    of = stage(of, "classes")
    heads = of.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_key = of.join(heads, "root").select("key", "class_id")
    return (rows.join(by_key, "key")
            .select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Same columns as ``docs``: one document of each class, that of the least
    doc_id (of repeated rows, one)."""
    _, of = _classes(docs, threshold)
    head = of.groupBy("root").agg(F.min_by(F.struct("rep", "key"), F.struct(F.col("rep").isNull(), "rep", "key")).alias("s"))
    own = private(docs)
    kept = head.select(F.col("s.rep").alias(f"{own}id"), F.col("s.key").alias(f"{own}head"))
    rows = docs.withColumn(f"{own}key", text_key())
    same = rows["doc_id"].eqNullSafe(kept[f"{own}id"]) & (rows[f"{own}key"] == kept[f"{own}head"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", f"{own}key"]).drop(f"{own}key")
