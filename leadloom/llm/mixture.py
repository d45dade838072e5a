"""Mixing sources to target weights by Sainte-Lague apportionment (operator 11, native).

Every source has a target number of tokens (words): its weight's share of all
tokens, at most ``CEILING`` times what it has; what is above a ceiling goes to the
others by weight (``targets``). The mix is dealt in blocks of equally many
tokens. ``quotas`` gives the blocks to sources by highest quotients
``target / (2 k + 1)``, ties to the source that comes first, in the order of the
output shards: the blocks of shards 0 to h together are the apportionment of
that many blocks, so every shard holds an equal number of blocks (at most one
more or less) in nearly the target proportions.

``mix`` then selects blocks: a source's documents lie on a line in seeded random
order (md5 of seed, id and text), its blocks are taken from the line's beginning
and again from there once the line is used up, each shard going on where the one
before it ended. A document comes out with the spans of words that each shard takes.

Everything is DataFrame expressions. Scale: one scan of the texts writes narrow
rows; a source is cut into chunks of about ``CHUNK_ROWS`` documents by ranges of
the order key, so a source with most of the rows is many tasks; chunk sums
become chunk starts. One row per source (and per source and shard) and one per
chunk meet in a window. The highest quotients are found among about two
candidates per source and shard, whatever the number of blocks.

Block size: ``1 / BLOCKS_LEAST`` of the smallest target, at least one and at
most ``BLOCK_MAX`` tokens, so a source misses its target by a block or two. A source
at its ceiling ends there, within its last block.

Edge cases: null text has no words, is taken 0 times and keeps its row; a null
source is a source and comes last; rows of equal id and text are ordered by
size, equal rows are interchangeable; documents without words share nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_or_empty

SEED = 11
SHARDS = 16
CEILING = 3
#: weights of the sources in ascending order, repeating
WEIGHTS = (1, 2, 3)
BLOCK_MAX = 1024
BLOCKS_LEAST = 128
CHUNK_ROWS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"
_HALF_KEY = 30


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """Narrow rows: doc_id, the source in two null-free columns, size, and the
    60-bit order key."""
    text = text_or_empty()
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("_key"))


def targets(sources: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """Adds ``target`` (double) to rows of (ord, weight, source_size).

    In the order of ``ceiling * source_size / weight`` the first sources stop at
    their ceilings; the first one whose share of what is left, by the weights
    that are left, is not above its ceiling sets the level of all after it."""
    cap = F.col("source_size") * ceiling
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "ord")
    s = sources.withColumn("_cap", cap)
    s = s.withColumns({
        "_all": F.sum("source_size").over(Window.partitionBy()),
        "_place": F.row_number().over(by_level),
        "_full": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_weights": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    left = F.col("_all") - F.col("_full")
    fits = left * F.col("weight") <= F.col("_cap") * F.col("_weights")
    s = s.withColumn("_first", F.min(F.when(fits, F.struct("_place", left.alias("left"), F.col("_weights").alias("weights"))))
                     .over(Window.partitionBy()))
    share = (F.col("weight") * F.col("_first.left")).cast("double") / F.col("_first.weights")
    return s.withColumn("target", F.when(F.col("_place") < F.col("_first._place"), F.col("_cap").cast("double")).otherwise(share)).drop(
        "_cap", "_all", "_place", "_full", "_weights", "_first")


def quotas(planned: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(ord, block, ends) of rows (ord, target): the block size and the blocks
    that the source has in shards 0 to h together, for every h."""
    everything = Window.partitionBy()
    s = planned.where("target > 0").select(
        "ord", "target", F.sum("target").over(everything).alias("_all"), F.count(F.lit(1)).over(everything).alias("_n"),
        F.greatest(F.lit(1), F.least(F.lit(BLOCK_MAX), F.floor(F.min("target").over(everything) / BLOCKS_LEAST))).cast("long").alias("block"))
    s = s.withColumn("_blocks", F.floor(F.col("_all") / F.col("block") + 0.5).cast("long"))
    s = s.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    house = F.floor(F.col("_blocks") * (F.col("shard") + 1) / shards).cast("long")
    s = s.withColumn("_house", house)
    # seats at a divisor are target / divisor, rounded; these two divisors give at most and at least _house seats
    few, many = F.col("_house") - F.col("_n") / 2, F.col("_house") + F.col("_n") / 2
    part = F.col("target") / F.col("_all")
    s = s.withColumns({"_sure": F.greatest(F.lit(0), F.floor(part * few + 0.5) - 1).cast("long"),
                       "_most": (F.floor(part * many + 0.5) + 1).cast("long")})
    s = s.withColumn("_open", F.col("_house") - F.sum("_sure").over(Window.partitionBy("shard")))
    seats = s.withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc(), "ord", "_k")
    seats = seats.withColumn("_won", (F.row_number().over(best) <= F.col("_open")).cast("long"))
    got = seats.groupBy("ord", "shard").agg(F.first("block").alias("block"), (F.first("_sure") + F.sum("_won")).alias("_seats"))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "_seats"))), lambda x: x["_seats"])
    return got.groupBy("ord").agg(F.first("block").alias("block"), ends.alias("ends"))


def plan(parts: DataFrame, shards: int = SHARDS, ceiling: int = CEILING, weights=WEIGHTS) -> DataFrame:
    """One row per source of (_s, _none, ..., tokens) rows: source_size, weight,
    target, block and ``upto``, the tokens of its line that shards 0 to h take."""
    order = Window.orderBy("_none", "_s")
    s = parts.groupBy("_s", "_none").agg(F.sum("tokens").alias("source_size")).withColumn("ord", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    s = targets(s.withColumn("weight", weight.cast("long")), ceiling)
    s = s.join(quotas(s, shards), "ord", "left")
    upto = F.transform("ends", lambda e: F.least(e * F.col("block"), F.col("source_size") * ceiling))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    return s.select("_s", "_none", "source_size", "weight", "target", "block", F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("blocks"),
                    F.coalesce(upto, none).alias("upto"))


def spans(start: Column, size: Column, line: Column, upto: Column, shards: int, ceiling: int) -> Column:
    """What each shard takes of the words [start, start + size) of a line that
    is gone through again and again: (shard, lap, first word, number of words)."""
    def one(lap: Column, h: Column) -> Column:
        at = start + lap * line
        lo = F.greatest(at, F.when(h == 0, F.lit(0).cast("long")).otherwise(F.get(upto, h - 1)))
        hi = F.least(at + size, F.get(upto, h))
        return F.struct(h.alias("shard"), lap.alias("lap"), (lo - at).alias("start"), (hi - lo).alias("n"))

    laps = F.sequence(F.lit(0), F.lit(ceiling - 1))
    each = F.transform(laps, lambda lap: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: one(lap, h)))
    return F.filter(F.flatten(each), lambda x: x["n"] > 0)


def mix(docs: DataFrame, shards: int = SHARDS, ceiling: int = CEILING, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, block and blocks (of
    its source), and ``spans``: what each shard takes of the document."""
    rows = stage(measured(docs, seed), "mixrows")
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    # a range of the key, so chunks in order are the order of the key
    rows = rows.withColumn("_chunk", F.shiftright(F.shiftright("_key", _HALF_KEY) * chunks, _HALF_KEY))
    parts = stage(rows.groupBy("_s", "_none", "_chunk").agg(F.sum("size").alias("tokens")), "mixparts")
    before = Window.partitionBy("_s", "_none").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")
    # written, so that the planner knows its size
    starts = stage(starts.join(plan(parts, shards, ceiling, weights), ["_s", "_none"]), "mixstarts")
    within = Window.partitionBy("_s", "_none", "_chunk").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["_s", "_none", "_chunk"])
    taken = spans(F.col("_start") + F.col("_at"), F.col("size"), F.col("source_size"), F.col("upto"), shards, ceiling)
    return placed.select("doc_id", F.when(~F.col("_none"), F.col("_s")).alias("source"), "size", "source_size", "weight", "target",
                         "block", "blocks", taken.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in all
    spans), and its source's number of blocks."""
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("blocks").alias("source_blocks"))
