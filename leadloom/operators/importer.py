"""Import a lead file with duplicate skipping.

* every row is considered, or the first ``max_rows`` (by ``ord``) where the
  caller asks for a limit;
* file columns are renamed by the fixed spelling map (a column already named
  like the target wins, else the first spelling in map order);
* cells with a missing-value spelling count as missing;
* rows whose stripped name is missing or the text 'nan' are skipped;
* a row is skipped when its name key exists among the stored leads or was
  imported from an earlier row of the same file (the empty key is an ordinary
  key here);
* other values are stripped, missing becomes ''; the raw phone is kept and
  classified; sources = 'imported'.

Plan: the file is read once and reduced to one row per key (the first by
``ord``, map-side partial aggregation); the stored leads' keys anti-join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify_phone, name_key, py_strip
from ..functions.patterns import IMPORT_RENAMES, MISSING_CELLS

FIELDS = ["name", "phone", "website", "address", "category"]


def rename_import_columns(df: DataFrame) -> DataFrame:
    """Apply the spelling map; targets present under their own name win."""
    targets: dict[str, str] = {}
    for src, dst in IMPORT_RENAMES:
        if src in df.columns and dst not in df.columns and dst not in targets:
            targets[dst] = src
    out = df
    for dst, src in targets.items():
        out = out.withColumnRenamed(src, dst)
    return out


def _clean(c: str, df: DataFrame) -> Column:
    """The stripped cell; '' when missing."""
    if c not in df.columns:
        return F.lit("")
    raw = F.col(c).cast("string")
    s = py_strip(raw)
    return F.when(raw.isNull() | raw.isin(MISSING_CELLS) | (s == "nan"), F.lit("")).otherwise(s)


def considered_rows(file_df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The cleaned rows an import looks at: ord, name_key (NULL: no name) and
    the fields; with ``max_rows`` only the first by ``ord``."""
    if "ord" not in file_df.columns:
        raise ValueError("import rows need an explicit 'ord' column (file order decides)")
    rows = rename_import_columns(file_df)
    if max_rows is not None:
        rows = rows.orderBy("ord").limit(max_rows)
    rows = rows.select("ord", *[_clean(c, rows).alias(c) for c in FIELDS])
    return rows.withColumn("name_key", F.when(F.col("name") != "", name_key("name")))


def _first_per_key(rows: DataFrame) -> DataFrame:
    """One row per key: the first by ``ord`` and the number of rows. Rows
    without a name are counted under the NULL key."""
    first = F.min(F.struct("ord", *FIELDS)).alias("f")
    return rows.groupBy("name_key").agg(first, F.count(F.lit(1)).alias("rows"))


def _stored_keys(leads: DataFrame) -> DataFrame:
    return leads.select(name_key("name").alias("name_key")).distinct()


def _asked(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored keys that the file asks for, each once: the file's distinct keys
    are the side that Spark may broadcast, the stored keys the one it streams."""
    return stored.join(wanted, "name_key", "left_semi").distinct()


def new_rows(file_df: DataFrame, stored: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``import_leads`` against a table of stored keys (``name_key``, any number
    of rows a key)."""
    rows = considered_rows(file_df, max_rows)
    return _fresh(rows, _asked(stored, rows.select("name_key").distinct()))


def new_counts(file_df: DataFrame, stored: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``import_counts`` against a table of stored keys."""
    rows = considered_rows(file_df, max_rows)
    return _counted(rows, _asked(stored, rows.select("name_key").distinct()))


def _fresh(rows: DataFrame, known: DataFrame) -> DataFrame:
    keyed = _first_per_key(rows).where(F.col("name_key").isNotNull())
    return (keyed.join(known, "name_key", "left_anti").select("f.*")
            .select("ord", "name", "phone", classify_phone("phone").alias("phone_type"),
                    "website", "address", "category", F.lit("imported").alias("sources")))


def _counted(rows: DataFrame, known: DataFrame) -> DataFrame:
    per_key = rows.groupBy("name_key").agg(F.count(F.lit(1)).alias("rows"))
    flagged = per_key.join(known.withColumn("known", F.lit(True)), "name_key", "left")
    fresh = F.col("name_key").isNotNull() & F.col("known").isNull()
    total, new = F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(fresh)
    return flagged.agg(new.cast("bigint").alias("imported"), (total - new).cast("bigint").alias("skipped"))


def import_leads(file_df: DataFrame, leads: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows to append to the leads table (ids are assigned by the caller)."""
    return _fresh(considered_rows(file_df, max_rows), _stored_keys(leads))


def import_counts(file_df: DataFrame, leads: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(imported, skipped) over the considered rows; an empty file gives 0, 0."""
    return _counted(considered_rows(file_df, max_rows), _stored_keys(leads))
