"""Counts of the committed leads table without reading leads.

``build`` writes, beside every data folder of the current version that has none
yet, how many of its leads fall under each (kind, name): all leads, the phone
types, leads without a phone, every source name and every session. The counts of a
bucket never change, so an append or a rewrite only summarises what it has
written, and the counts of a table are the sums over its buckets.

``stats``, ``facets``, ``lead_total`` and ``session_counts`` give the rows of
``filters.view_stats``, ``filters.source_facets``, ``filters.lead_count`` and
``mutations.current_counts`` over the whole table. Buckets without a summary are
counted from their leads, so results are those of the scan in every case;
filtered views need the scan.

Edge cases: a table without a commit raises ``FileNotFoundError`` as the scan does;
one without leads counts 0; a source named twice in a lead counts once; a NULL or blank
source and a NULL session have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import py_strip
from ..operators.filters import phone_mask
from . import leads as LD

SUMMARY = "folder string, kind string, name string, n long"


def _part(folder: str) -> str:
    """A bucket folder below its table: data folder / bucket."""
    return "/".join(folder.rstrip("/").split("/")[-2:])


def _place(root: str, data: str) -> str:
    return f"{root}/_summary/{data}"


def _by_data(folders: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in folders:
        out.setdefault(_part(f).split("/")[0], []).append(f)
    return out


def _entries() -> Column:
    """The (kind, name) pairs that a lead counts under."""
    def entry(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    none = F.lit("")
    flags = F.array_compact(F.array(
        entry("lead", none), *[F.when(phone_mask(m), entry(m, none)) for m in ("mobile", "landline", "no_phone")],
        F.when(F.col("session_id").isNotNull(), entry("session", F.col("session_id").cast("string")))))
    parts = F.transform(F.split(F.coalesce("sources", none), ","), lambda s: py_strip(s))
    named = F.transform(F.array_distinct(F.filter(parts, lambda s: s != "")), lambda s: entry("source", s))
    return F.concat(flags, named)


def summarise(leads: DataFrame, *by: Column) -> DataFrame:
    """(kind, name, n) of some leads, per value of ``by``: one scan, reduced
    before the shuffle."""
    return leads.select(*by, F.inline(_entries())).groupBy(*[c for c in ("folder",) if by], "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def build(spark: SparkSession, root: str) -> int:
    """Summarise the data folders of the current version that are not yet; returns
    their number. A failed build leaves no mark, and the folder is summarised again."""
    root = root.rstrip("/")
    todo = {d: fs for d, fs in _by_data(LD.current(spark, root)[1]).items() if not _summarised(spark, root, d)}
    for data, folders in todo.items():            # one job a commit
        bucket = F.floor(F.col("id") / LD.BUCKET_IDS).cast("long").cast("string")
        folder = F.concat(F.lit(f"{data}/{LD._BUCKET}="), bucket).alias("folder")
        summarise(LD._read(spark, folders), folder).write.mode("overwrite").parquet(_place(root, data))
    return len(todo)


def _summarised(spark: SparkSession, root: str, data: str) -> bool:
    return "_SUCCESS" in LD._names(spark, _place(root, data))


def counts(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, n) over the current version."""
    root = root.rstrip("/")
    version, folders, _ = LD.current(spark, root)
    if not version:
        raise FileNotFoundError(f"no version committed below {root}")
    by_data = _by_data(folders)
    ready = [d for d in by_data if _summarised(spark, root, d)]
    rest = [f for d, fs in by_data.items() if d not in set(ready) for f in fs]
    rows = summarise(LD._read(spark, rest))
    if ready:
        # one row a bucket: of a commit some buckets may have been written anew since
        now = spark.createDataFrame([(_part(f),) for d in ready for f in by_data[d]], "folder string")
        stored = spark.read.schema(SUMMARY).parquet(*[_place(root, d) for d in ready]).join(now, "folder", "left_semi").drop("folder")
        rows = stored.unionByName(rows) if rest else stored
    return rows.groupBy("kind", "name").agg(F.sum("n").alias("n"))


def _total(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))


def stats(spark: SparkSession, root: str) -> DataFrame:
    """``view_stats`` of the whole table."""
    return counts(spark, root).agg(_total("lead").alias("showing"), *[_total(k).alias(k) for k in ("mobile", "landline", "no_phone")])


def lead_total(spark: SparkSession, root: str) -> DataFrame:
    """``lead_count`` of the whole table."""
    return counts(spark, root).agg(_total("lead").alias("leads"))


def facets(spark: SparkSession, root: str) -> DataFrame:
    """``source_facets`` of the whole table."""
    return counts(spark, root).where("kind = 'source'").select(F.col("name").alias("source")).orderBy("source")


def session_counts(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """``current_counts`` of the whole table."""
    now = counts(spark, root).where("kind = 'session'").select(F.col("name").cast("long").alias("id"), F.col("n").alias("current_count"))
    return sessions.join(now, "id", "left").fillna(0, ["current_count"])
