"""Blocklist of company names (a settings value: JSON list of strings).

The blocklist is configuration supplied by the user (a JSON list, a text file
with one entry per line, or a DataFrame column). No default list ships with
this package.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip, quote_regex

def entries_frame(settings: DataFrame, value: str = "value") -> DataFrame:
    """Settings rows -> the rows' other columns, pos, entry: the JSON list is
    parsed and exploded, entries are stripped, blank ones go."""
    keep = [c for c in settings.columns if c != value]
    return (settings.select(*keep, F.posexplode(F.from_json(value, "array<string>")).alias("pos", "entry"))
            .select(*keep, "pos", py_strip("entry").alias("entry")).where(F.col("entry") != ""))


def setting_pattern(spark: SparkSession, json_text: str) -> str | None:
    """The pattern of one blocklist setting, through its entries frame."""
    entries = entries_frame(spark.createDataFrame([(json_text,)], "value string"))
    return blocklist_pattern([r["entry"] for r in entries.orderBy("pos").collect()])


def entries_from_text(text: str) -> list[str]:
    """Blocklist editor text -> entries (blank lines dropped, entries stripped)."""
    return [ln.strip() for ln in text.strip().splitlines() if ln.strip()]


def blocklist_pattern(entries: list[str] | str | None, keep_spaces: bool = False) -> str | None:
    """One case-insensitive alternation of the stripped, lower-cased, escaped
    entries. Blank entries are dropped; an empty result means 'block nothing'.

    Entries lose their surrounding blanks at compile time, so 'ey ' also
    blocks 'money'; ``keep_spaces=True`` keeps them.
    """
    if entries is None:
        return None
    if isinstance(entries, str):
        entries = json.loads(entries)
    parts = []
    for e in entries:
        if not e.strip():
            continue
        parts.append(quote_regex((e if keep_spaces else e.strip()).lower()))
    if not parts:
        return None
    return "(?iu)(" + "|".join(parts) + ")"
