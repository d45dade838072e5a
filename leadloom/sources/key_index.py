"""Name keys of the committed leads table, stored beside its leads.

``build`` writes, for every data folder of the current version that has none yet,
one row per (bucket, name key): the lead that de-duplication would keep of
them (highest completeness, then lowest id), its completeness and how many leads have the key.
Data folders never change, so an append or a rewrite only computes keys of the
leads it has written; buckets without stored keys are computed from their leads, so
results are those of the scan in every case.

* ``import_committed`` / ``import_counts_committed``: the rows of an import file
  that no stored lead has, tested against stored keys.
* ``removable`` / ``dedupe_committed``: the leads that de-duplication deletes, found
  from stored keys; the commit writes only the buckets that lose leads.

Scale: an index row is a key and three numbers, reduced map-side where it is
written. An import first keeps the stored keys that the file asks for (a
semi-join whose small side is the file's distinct keys, broadcast where Spark
measures them small), so the index is scanned but moved only where the file is as
large. A key that a third of all leads have is one row per bucket.

Edge cases: a table without a commit raises ``FileNotFoundError`` as the scan does;
one without leads has no keys; a NULL name has the empty key. The empty key is an
ordinary key for an import, and de-duplication leaves its leads alone, as the operators
over frames do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import name_key
from ..operators.dedupe import best_of, best_columns, completeness
from ..operators.importer import new_counts, new_rows
from . import leads as LD
from .summary import _by_data, _part

KEYS = "folder string, name_key string, id long, score int, rows long"


def _place(root: str, data: str) -> str:
    return f"{root}/_keys/{data}"


def _stored(spark: SparkSession, root: str, data: str) -> bool:
    return "_SUCCESS" in LD._names(spark, _place(root, data))


def keys_of(leads: DataFrame, folder: Column) -> DataFrame:
    """(folder, name_key, id, score, rows) of some leads: one scan, one hash
    aggregation over longs."""
    rows = leads.select(folder.alias("folder"), name_key("name").alias("name_key"), "id", completeness(leads).alias("score"))
    return (rows.groupBy("folder", "name_key").agg(*best_columns("score", "id"), F.count(F.lit(1)).alias("rows"))
            .select("folder", "name_key", *best_of(), "rows"))


def _folder(data: str) -> Column:
    bucket = F.floor(F.col("id") / LD.BUCKET_IDS).cast("long").cast("string")
    return F.concat(F.lit(f"{data}/{LD._BUCKET}="), bucket)


def build(spark: SparkSession, root: str) -> int:
    """Store the keys of the data folders of the current version that have none;
    returns their number. A failed build leaves no mark, and the folder is done again."""
    root = root.rstrip("/")
    todo = {d: fs for d, fs in _by_data(LD.current(spark, root)[1]).items() if not _stored(spark, root, d)}
    for data, folders in todo.items():            # one job a commit
        keys_of(LD._read(spark, folders), _folder(data)).write.mode("overwrite").parquet(_place(root, data))
    return len(todo)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The key rows of the current version's buckets."""
    root = root.rstrip("/")
    version, folders, _ = LD.current(spark, root)
    if not version:
        raise FileNotFoundError(f"no version committed below {root}")
    by_data = _by_data(folders)
    ready = [d for d in by_data if _stored(spark, root, d)]
    parts = [keys_of(LD._read(spark, fs), _folder(d)) for d, fs in by_data.items() if d not in set(ready)]
    if ready:
        # one row a bucket: of a commit some buckets may have been written anew since
        now = spark.createDataFrame([(_part(f),) for d in ready for f in by_data[d]], "folder string")
        stored = spark.read.schema(KEYS).parquet(*[_place(root, d) for d in ready])
        parts.append(stored.join(F.broadcast(now), "folder", "left_semi").select("folder", "name_key", "id", "score", "rows"))
    out = parts[0] if parts else spark.createDataFrame([], KEYS)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def import_committed(spark: SparkSession, root: str, file_df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``importer.import_leads`` against the committed table."""
    return new_rows(file_df, entries(spark, root).select("name_key"), max_rows)


def import_counts_committed(spark: SparkSession, root: str, file_df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``importer.import_counts`` against the committed table."""
    return new_counts(file_df, entries(spark, root).select("name_key"), max_rows)


def _judged(spark: SparkSession, root: str) -> DataFrame:
    """Key rows of non-empty keys with the id that is kept of all leads of the key."""
    rows = entries(spark, root).where("name_key <> ''")
    kept = rows.groupBy("name_key").agg(*best_columns("score", "id")).select("name_key", best_of()[0].alias("kept"))
    return rows.join(kept, "name_key")


def removable(spark: SparkSession, root: str) -> DataFrame:
    """``(buckets, leads)`` that de-duplication would write anew and delete; no lead
    file of an indexed bucket is read."""
    j = _judged(spark, root)
    gone = F.col("rows") - F.when(F.col("id") == F.col("kept"), 1).otherwise(0)
    per = j.groupBy("folder").agg(F.sum(gone).alias("gone")).where("gone > 0")
    return per.agg(F.count_distinct(F.substring_index("folder", "=", -1)).alias("buckets"), F.coalesce(F.sum("gone"), F.lit(0)).alias("leads"))


def dedupe_committed(spark: SparkSession, root: str) -> tuple[int, int]:
    """De-duplicate the committed table: the buckets that lose leads are read,
    reduced to the kept ones and written. Returns (version, buckets written);
    ``CommitConflict`` where another job committed since the keys were read."""
    version = LD.current(spark, root)[0]
    j = _judged(spark, root)
    losing = j.where((F.col("rows") > 1) | (F.col("id") != F.col("kept"))).select("id")
    kept = j.where(F.col("id") == F.col("kept")).select("id", F.lit(True).alias("_kept"))

    def change(leads: DataFrame) -> DataFrame:
        # the join is on the unique id: a hot key is no hot group
        out = leads.join(kept, "id", "left").where(F.col("_kept") | (name_key("name") == ""))
        return out.select(*leads.columns)

    return LD.rewrite(spark, root, losing, change, base=version)
