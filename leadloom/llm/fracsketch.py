"""Threshold-scaled document sketches (operator 3, native).

A text's shingles are its runs of five words (a text of fewer words is one
shingle; words: lower-cased A-Z, cut at ASCII white space). Every shingle hash
below the fixed fraction ``1 / SCALE`` of the hash range is kept, so the sketch
grows with the document, sketches of parts merge by set union, and the overlap
of two sketches estimates containment even for very unequal documents. The
fingerprint is the sorted list of kept hashes in hexadecimal.

``likeness`` is the containment of the smaller sketch in the larger one; two
empty sketches are alike only if the texts are equal.

Everything is DataFrame expressions. Scale: one shuffle of the texts, into
blocks of neighbouring ids; the first document of a block also goes to the
block before it, so the next document is always a neighbour in the same block.
Blocks are equal widths of the ids; one that holds more than twice
``BLOCK_ROWS`` documents is cut again by the ids in it, and one of a single id by
text hashes, until none is left (only rows equal in id and text stay together).
The order of the blocks is found in ranges, of which one row each meets in one
task. Ids are whole numbers.

Edge cases: null text is empty, its fingerprint ``''``; null ids come first;
repeated ids are ordered by text hash; one document alone is followed by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_or_empty

SHINGLE = 5
SCALE = 8
HASH_BITS = 48
BLOCK_ROWS = 1024


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[ \\t-\\r]+"), lambda w: w != "")


def sketch(text: Column) -> Column:
    """Sorted array of the kept shingle hashes of a text."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    limit = (1 << HASH_BITS) // SCALE

    def of(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - HASH_BITS))).otherwise(F.array().cast("array<bigint>"))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.shiftrightunsigned(
            F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]), 64 - HASH_BITS))
        return F.when(n >= SHINGLE, runs).otherwise(whole)

    # one-element transform: the word hashes are computed once and named
    kept = F.transform(F.array(hashes), lambda h: F.filter(of(h), lambda x: x < limit))
    return F.array_sort(F.array_distinct(F.get(kept, F.lit(0))))


def fingerprint(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.lower(F.hex(x))), " ")


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Containment of the smaller sketch in the larger."""
    least = F.least(F.size(a), F.size(b))
    return (F.when(equal, F.lit(1.0)).when(least == 0, F.lit(0.0))
            .otherwise(common(a, b) / least).cast("double"))


def jaccard(a: Column, b: Column, equal: Column) -> Column:
    union = F.size(a) + F.size(b) - common(a, b)
    return F.when(equal, F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(common(a, b) / union).cast("double")


def _part(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Which of about ``n / BLOCK_ROWS`` equal parts of lo..hi holds ``x``. Of
    lo < hi both ends have different parts where n > BLOCK_ROWS."""
    def past(v: Column) -> Column:      # exact where 64 bits hold it, never falling anywhere
        return F.coalesce(F.try_subtract(v, lo).cast("double"), v.cast("double") - lo.cast("double"))
    width = F.greatest(F.lit(1.0), (past(hi) + 1) / F.ceil(n / BLOCK_ROWS))
    return F.floor(past(x) / width).cast("long")


def _spans(rows: DataFrame) -> DataFrame:
    """One row per block: its rows, the ends of its ids and ties, its first row."""
    return stage(rows.groupBy("_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.min("_tie").alias("tlo"), F.max("_tie").alias("thi"), F.min(F.struct("doc_id", "_tie")).alias("f")), "spans")


def in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with doc_id and _tie) with a ``_block`` that never falls as
    (doc_id, _tie) grows, and the blocks' spans. A block that holds more than
    twice ``BLOCK_ROWS`` is cut again, by its own ids, then by its ties."""
    ends = rows.agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(_part(F.col("doc_id"), F.col("_lo"), F.col("_hi"), F.col("_n")), F.lit(-1).cast("long"))
    out = rows.crossJoin(F.broadcast(ends)).withColumn("_block", F.array(first)).drop("_lo", "_hi", "_n")   # with one row
    while True:
        spans = _spans(out)
        wide = spans.where((F.col("n") > 2 * BLOCK_ROWS) & ((F.col("lo") < F.col("hi")) | (F.col("tlo") < F.col("thi"))))
        if wide.isEmpty():
            return out, spans
        cut = F.when(F.col("lo") < F.col("hi"), _part(F.col("doc_id"), F.col("lo"), F.col("hi"), F.col("n"))).otherwise(
            _part(F.col("_tie"), F.col("tlo"), F.col("thi"), F.col("n")))
        found = out.join(wide.select(F.col("_block").alias("_wide"), "n", "lo", "hi", "tlo", "thi"), F.col("_block") == F.col("_wide"), "left")
        out = found.withColumn("_block", F.when(F.col("_wide").isNull(), F.col("_block")).otherwise(
            F.concat("_block", F.array(cut)))).drop("_wide", "n", "lo", "hi", "tlo", "thi")


def _before(spans: DataFrame) -> DataFrame:
    """(_own, _before): the block before each block, before the first the last.
    Blocks are ordered in ranges; only the ranges (one row per task) meet."""
    ranged = stage(spans.select("_block").repartitionByRange("_block").withColumn("_range", F.spark_partition_id()), "ranges")
    tails = ranged.groupBy("_range").agg(F.max("_block").alias("_tail"))
    tails = tails.select("_range", F.lag("_tail").over(Window.orderBy("_range")).alias("_tail_before"))
    last = ranged.agg(F.max("_block").alias("_last"))
    inner = F.lag("_block").over(Window.partitionBy("_range").orderBy("_block"))
    return (ranged.withColumn("_inner", inner).join(tails, "_range").crossJoin(F.broadcast(last))
            .select(F.col("_block").alias("_own"), F.coalesce("_inner", "_tail_before", "_last").alias("_before")))


def with_next(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """doc_id, the columns of ``carry`` and, as ``next_<name>``, those of the
    next document in ascending doc_id (after the last: the first)."""
    order = ["doc_id", "_tie"]
    rows, spans = in_blocks(docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_tie"), "text"))
    to = _before(spans)
    heads = spans.join(to, spans["_block"] == to["_own"]).select(
        F.col("_own").alias("_hb"), F.col("f.doc_id").alias("_hid"), F.col("f._tie").alias("_ht"), "_before")
    # written, so that the planner knows its size: the texts move for this join only where it is large
    heads = stage(heads, "heads")
    # each row to its own block, the head of a block to the one before as well
    joined = rows.join(heads, (rows["_block"] == heads["_hb"]) & rows["doc_id"].eqNullSafe(heads["_hid"]) & (rows["_tie"] == heads["_ht"]), "left")
    own = F.struct(F.col("_block").alias("b"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("_before").alias("b"), F.lit(1).alias("guard"))
    copies = F.when(F.col("_before").isNotNull(), F.array(own, guard)).otherwise(F.array(own))
    dealt = joined.withColumns(carry).select("doc_id", "_tie", F.explode(copies).alias("_at"), *carry)
    near = Window.partitionBy("_at.b").orderBy("_at.guard", *order)
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(near) for c in carry})
    return out.where("_at.guard = 0").select("doc_id", *carry, *[f"next_{c}" for c in carry])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and the Jaccard likenesses."""
    clean = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(clean, {"text": F.col("text"), "kept": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    e = rows.select("doc_id", "text", "kept", "next_kept", n.cast("long").alias("n_chars"), edited.alias("edited"),
                    (F.col("text") == F.col("next_text")).alias("same_next"))
    e = e.select("doc_id", "n_chars", "kept", "next_kept", "same_next", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 (F.col("text") == F.col("edited")).alias("same_edited"), sketch(F.col("edited")).alias("edited_kept"))
    return e.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("kept")).alias("fingerprint"),
                    fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
                    likeness(F.col("kept"), F.col("edited_kept"), F.col("same_edited")).alias("near_edited"),
                    likeness(F.col("kept"), F.col("next_kept"), F.col("same_next")).alias("near_next"),
                    jaccard(F.col("kept"), F.col("edited_kept"), F.col("same_edited")).alias("jaccard_edited"),
                    jaccard(F.col("kept"), F.col("next_kept"), F.col("same_next")).alias("jaccard_next"))
