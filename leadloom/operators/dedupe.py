"""De-duplicate stored leads by company-name key.

Per non-empty key keep the lead with the highest completeness score (phone 2;
website, address, category, tags 1 each), ties to the lowest id; delete the
rest without merging fields. Leads with an empty key are kept untouched.

Plan: one hash aggregation with map-side partial aggregation picks the winner
id per key, and one join on the unique ``id`` keeps the winners (an inner join:
a semi-join would be pushed into the branches of a union and repeated there). A key
holding a third of all rows is reduced map-side to one candidate per task, so
no task ever sorts or holds a whole group. Nothing runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import name_key


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def completeness(df: DataFrame) -> Column:
    return (F.when(_present("phone"), 2).otherwise(0)
            + sum(F.when(_present(c), 1).otherwise(0)
                  for c in ["website", "address", "category", "tags"]))


MAX_SCORE = 6


def best_columns(score: str, id_: str) -> list[Column]:
    """Aggregates that find the lowest id of the highest score: one ``min`` over
    longs per score, which keeps the aggregation on the hash fast path."""
    return [F.min(F.when(F.col(score) == s, F.col(id_))).alias(f"s{s}") for s in range(MAX_SCORE, -1, -1)]


def best_of() -> list[Column]:
    """(id, score) from the aggregates of ``best_columns``."""
    found = range(MAX_SCORE, -1, -1)
    return [F.coalesce(*[F.col(f"s{s}") for s in found]).alias("id"),
            F.coalesce(*[F.when(F.col(f"s{s}").isNotNull(), s) for s in found]).alias("score")]


def _winners(leads: DataFrame) -> DataFrame:
    """Winner ids. A lead with an empty key is a group of its own."""
    keyed = leads.select("id", name_key("name").alias("_key"), completeness(leads).alias("_score"))
    alone = F.when(F.col("_key") == "", F.col("id"))
    return keyed.groupBy("_key", alone.alias("_alone")).agg(*best_columns("_score", "id")).select(best_of()[0])


def dedupe_removed(leads: DataFrame) -> DataFrame:
    """Leads the de-duplication deletes (id and key); ``count()`` is the
    number deleted."""
    kept = _winners(leads).withColumn("_kept", F.lit(True))
    gone = leads.select("id", "name").join(kept, "id", "left").where("_kept is null")
    return gone.select("id", name_key("name").alias("name_key"))


def dedupe_leads(leads: DataFrame) -> DataFrame:
    """Leads after de-duplication (same columns)."""
    return leads.join(_winners(leads), "id").select(*leads.columns)
