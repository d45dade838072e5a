"""Lead-table mutations as ``leads -> leads'`` transforms, plus sessions and
tags. Nothing is updated in place: callers write the result as a new snapshot
(``sources.leads.commit``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import (DEFAULT_TAG_COLOR, DEFAULT_TAGS, EDITABLE_COLUMNS,
                                  EXPORT_COLUMNS, EXPORT_DEFAULT_COUNT, SESSION_DETAIL_COLUMNS)
from ..schemas import SESSIONS, TAGS, conform, conform_leads
from ..session import reliable_checkpoint
from .filters import phone_filter

# ------------------------------------------------------------------ ids (M8)


def assign_ids(df: DataFrame, order_cols: list, start: int | Column, id_col: str = "id") -> DataFrame:
    """Dense ids ``start, start+1, ...`` in ``order_cols`` order without a
    single-partition window.

    The frame is range-partitioned and sorted by ``order_cols`` and then
    checkpointed (reliable, in ``spark.checkpoint.dir``) so both passes below
    see identical partitions. Per-partition row counts (one row per
    partition) give each partition its offset; rows add their position within
    the partition. Only the per-partition counts are broadcast; their number
    is the partition count, not the data size.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ordered = reliable_checkpoint(ordered)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    start_c = start if isinstance(start, Column) else F.lit(start)
    out = (tagged.join(F.broadcast(offsets), "_pid")
           .withColumn(id_col, start_c + F.coalesce(F.col("_off"), F.lit(0))
                       + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))))
    return out.drop("_pid", "_mid", "_off")


def next_id(table: DataFrame, high_water: int | None = None) -> int:
    """First free id: above both the stored high-water mark and every id in
    the table (ids are never reused, even after deletes)."""
    mx = table.agg(F.max("id")).first()[0]
    return max(high_water or 0, mx or 0) + 1


# ------------------------------------------------------------------ save listings

SAVED_FROM_LISTING = ["name", "phone", "phone_type", "website", "address", "category",
                      "company_size", "rating", "sources", "google_maps_url", "jobstreet_url",
                      "hiredly_url"]


def listings_as_leads(rows: DataFrame, session_id: int | None, start_id: int, as_of,
                      order_cols=("type_rank", "first_ord")) -> DataFrame:
    """New lead rows from merged listings, ids in merge order; missing columns
    take '', ``sources`` falls back to ``source``. No de-duplication against
    stored leads."""
    df = rows
    if "sources" not in df.columns:
        df = df.withColumn("sources", F.col("source") if "source" in df.columns else F.lit(""))
    keep = [c for c in SAVED_FROM_LISTING if c in df.columns]
    df = df.select(*keep, *[c for c in order_cols if c not in keep])
    df = df.withColumn("session_id", F.lit(session_id).cast("bigint"))
    df = assign_ids(df, list(order_cols), start_id)
    return conform_leads(df, as_of)


def save_listings(leads: DataFrame, rows: DataFrame, session_id: int | None, as_of,
                  high_water: int | None = None) -> DataFrame:
    """leads' = leads + new rows (append)."""
    new = listings_as_leads(rows, session_id, next_id(leads, high_water), as_of)
    return conform_leads(leads).unionByName(new)


# ------------------------------------------------------------------ edits (M2)


def apply_edits(leads: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """Batch edit: whitelisted columns only (those present in ``edits``),
    NULL -> '', rows without id skipped, the later row (by ``ord``) for an id
    wins, ``updated_at`` = as_of for edited ids. Editing ``phone`` does not
    re-classify ``phone_type``."""
    cols = [c for c in edits.columns if c in EDITABLE_COLUMNS]
    if not cols:
        return leads
    e = edits.where(F.col("id").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"), "ord",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_e_{c}") for c in cols])
    latest = (e.groupBy("id").agg(F.max(F.struct("ord", *[f"_e_{c}" for c in cols])).alias("_e"))
              .select("id", *[f"_e._e_{c}" for c in cols], F.lit(True).alias("_hit")))
    j = leads.join(latest, "id", "left")
    hit = F.col("_hit").isNotNull()
    out = j
    for c in cols:
        out = out.withColumn(c, F.when(hit, F.col(f"_e_{c}")).otherwise(F.col(c)))
    out = out.withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp"))
                         .otherwise(F.col("updated_at")))
    return out.select(*leads.columns)


def edit_count(edits: DataFrame) -> DataFrame:
    """Rows sent with an id (not rows changed)."""
    return edits.agg(F.count_if(F.col("id").isNotNull()).alias("edited"))


# ------------------------------------------------------------------ bulk tag (M3)


def append_tag(tags: Column, tag: str) -> Column:
    cur = F.coalesce(tags, F.lit(""))
    return F.btrim(F.concat(cur, F.lit(", "), F.lit(tag)), F.lit(", "))


def bulk_tag(leads: DataFrame, tag: str, as_of, ids: DataFrame | None = None,
             mask: Column | None = None, exact: bool = False) -> DataFrame:
    """Append ``tag`` to the leads of a view unless it is already a substring
    of ``tags`` (``exact=True`` tests whole comma-separated items instead).
    The view is either a predicate (``mask``) or an id frame (semi-join)."""
    if not tag:
        return leads.withColumn("_changed", F.lit(False))
    if ids is not None:
        marked = leads.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
        in_view = F.col("_in").isNotNull()
    else:
        marked = leads
        in_view = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    cur = F.coalesce(F.col("tags"), F.lit(""))
    present = (F.array_contains(F.transform(F.split(cur, ","), lambda x: F.trim(x)), F.lit(tag))
               if exact else cur.contains(tag))
    changed = in_view & ~present
    out = (marked.withColumn("_changed", changed)
           .withColumn("tags", F.when(F.col("_changed"), append_tag(F.col("tags"), tag))
                       .otherwise(F.col("tags")))
           .withColumn("updated_at", F.when(F.col("_changed"), F.lit(as_of).cast("timestamp"))
                       .otherwise(F.col("updated_at"))))
    return out.select(*leads.columns, "_changed")


# ------------------------------------------------------------------ sessions


def session_leads(leads: DataFrame, session_id: int) -> DataFrame:
    """Leads of one session (order by id at the sink)."""
    return leads.where(F.col("session_id") == F.lit(session_id))


def session_detail(leads: DataFrame, session_id: int) -> DataFrame:
    return session_leads(leads, session_id).select("id", *SESSION_DETAIL_COLUMNS)


def delete_session(leads: DataFrame, sessions: DataFrame, session_id: int):
    """(leads', sessions', deleted-leads frame). NULL sessions stay."""
    sid = F.lit(session_id).cast("bigint")
    kept = leads.where(~F.col("session_id").eqNullSafe(sid))
    deleted = leads.where(F.col("session_id").eqNullSafe(sid))
    return kept, sessions.where(F.col("id") != sid), deleted


def create_session(spark: SparkSession, sessions: DataFrame, sources: list[str], query_info: str,
                   result_count: int, as_of, high_water: int | None = None) -> DataFrame:
    """Append one session row (only call when the run found any raw result);
    ``sources`` lists the sources requested."""
    sid = next_id(sessions, high_water)
    row = spark.createDataFrame([(sid, ", ".join(sources), query_info, int(result_count), as_of)],
                                SESSIONS)
    return conform(sessions, SESSIONS).unionByName(row)


def session_for_run(merged: DataFrame, sessions: DataFrame, sources: list[str], query_info: str,
                    as_of, high_water: int = 0) -> DataFrame:
    """The session row of a collection run, built lazily: id = highest id ever
    given out + 1, result_count = companies saved by the run (stored, not
    recomputed later). Call only when the run found any raw result."""
    stats = (merged.select(F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("m"))
             .unionByName(sessions.select(F.lit(0).alias("n"), F.col("id").cast("bigint").alias("m")))
             .agg(F.sum("n").cast("bigint").alias("result_count"), F.max("m").alias("mx")))
    return stats.select((F.greatest(F.coalesce(F.col("mx"), F.lit(0)), F.lit(high_water).cast("bigint")) + 1).alias("id"),
                        F.lit(", ".join(sources)).alias("sources"), F.lit(query_info).alias("query_info"),
                        F.coalesce(F.col("result_count"), F.lit(0)).cast("bigint").alias("result_count"),
                        F.lit(as_of).cast("timestamp").alias("created_at"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Newest first (ties by id, newest first)."""
    return sessions.orderBy(F.col("created_at").desc(), F.col("id").desc())


def current_counts(sessions: DataFrame, leads: DataFrame) -> DataFrame:
    """Stored result_count next to the leads a session holds today."""
    now = leads.where(F.col("session_id").isNotNull()).groupBy(
        F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("current_count"))
    return sessions.join(now, "id", "left").fillna(0, ["current_count"])


# ------------------------------------------------------------------ tags (M7)


def seed_tags(spark: SparkSession, tags: DataFrame | None, as_of) -> DataFrame:
    """Default tags where there is no tags table yet; a table that a user has
    emptied stays empty."""
    if tags is not None:
        return tags
    rows = [(i + 1, n, c, as_of) for i, (n, c) in enumerate(DEFAULT_TAGS)]
    return spark.createDataFrame(rows, TAGS)


def add_tags(tags: DataFrame, names: DataFrame, as_of, color: str = DEFAULT_TAG_COLOR,
             high_water: int | None = None) -> DataFrame:
    """Add tag names not yet present (names are unique); ids continue from
    the highest id ever given out, in name order."""
    new = (names.select(F.trim(F.col("name")).alias("name")).where(F.col("name") != "")
           .distinct().join(tags.select("name"), "name", "left_anti"))
    new = assign_ids(new.withColumn("color", F.lit(color)), ["name"], next_id(tags, high_water))
    new = new.withColumn("created_at", F.lit(as_of).cast("timestamp"))
    return conform(tags, TAGS).unionByName(conform(new, TAGS))


def delete_tag(tags: DataFrame, name: str) -> DataFrame:
    """Remove a tag; lead ``tags`` text keeps it."""
    return tags.where(F.col("name") != name)


def list_tags(tags: DataFrame) -> DataFrame:
    return tags.orderBy("name")


# ------------------------------------------------------------------ export


def export_view(leads: DataFrame, phone: str = "all", columns: list[str] | None = None) -> DataFrame:
    """Phone filter -> chosen export columns (default: the first nine)."""
    columns = columns or EXPORT_COLUMNS[:EXPORT_DEFAULT_COUNT]
    unknown = [c for c in columns if c not in EXPORT_COLUMNS]
    if unknown:
        raise ValueError(f"unknown export columns {unknown}")
    return phone_filter(leads, phone).select(*columns)


def export_csv(leads: DataFrame, path: str, phone: str = "all", columns: list[str] | None = None) -> None:
    """Write the export view as CSV with a header (a folder of part files)."""
    export_view(leads, phone, columns).write.mode("errorifexists").options(
        header=True, escape='"', emptyValue="", nullValue="").csv(path)

