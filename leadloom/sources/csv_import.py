"""CSV import source: a lead file with a header row, every column as STRING.

Reading every column as text keeps leading zeros of phone numbers (type
inference would turn '0123' into 123). Quotes inside quoted cells are doubled,
and quoted cells may hold line breaks, also where Spark splits the file.

Whether a line begins inside a quoted cell depends on all lines before it, but
only by one bit, and a line maps that bit to the next in one of three ways: it
keeps it, flips it, or sets it (``_ways``). Such maps compose, so a running
window over each split and one row per split tell every line's bit. Lines that
begin outside quotes begin a record; only records of several lines are put
together by a grouping, all others stay where they are. A quote that is never
closed makes one record of the rest of its file, as for any CSV reader.

``ord`` records file order: files in path order, rows in file order (the
number of a row is its split's byte offset plus its line's place in the split;
a line has at least one byte, so numbers neither meet nor cross). Blank lines are
no rows.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_STRIDE = 1 << 44                    # bytes of the largest file

_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
#: a line that begins outside (inside) quotes and ends outside
_OUT_OUT = rf"^{_CELL}(?:,{_CELL})*+\z"
_IN_OUT = rf'^[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+(?:,{_CELL})*+\z'


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(_file, _block, _at, _line) of every line of every file; a line keeps a
    carriage return at its end."""
    text = spark.read.options(lineSep="\n", encoding=encoding).text(path)
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = text.select(F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_at"),
                       F.col("value").alias("_line"))
    return rows.withColumn("_line", F.when(F.col("_block") == 0, F.regexp_replace("_line", "^﻿", "")).otherwise(F.col("_line")))


def _ways(lines: DataFrame) -> DataFrame:
    """Adds ``_set`` (0 outside, 1 inside) where a line sets the bit, else NULL,
    and ``_flip`` 1 where it flips it."""
    line = F.regexp_replace("_line", r"\r\z", "")
    quoted = F.col("_line").contains('"')
    from_out, from_in = F.when(line.rlike(_OUT_OUT), 0).otherwise(1), F.when(line.rlike(_IN_OUT), 0).otherwise(1)
    ends = lines.withColumn("_ends", F.when(quoted, F.struct(from_out.alias("o"), from_in.alias("i"))))
    return (ends.withColumn("_set", F.when(F.col("_ends.o") == F.col("_ends.i"), F.col("_ends.o")))
            .withColumn("_flip", F.when((F.col("_ends.o") == 1) & (F.col("_ends.i") == 0), 1).otherwise(0)).drop("_ends"))


def _bit(w, carry) -> F.Column:
    """The bit after the rows of a window: the last one set, or what was carried
    in, flipped as often as rows have flipped it since."""
    flips = F.coalesce(F.sum("_flip").over(w), F.lit(0))
    last = F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_flips").alias("f"))), ignorenulls=True).over(w)
    return F.when(last.isNull(), (carry + flips) % 2).otherwise((last["v"] + flips - last["f"]) % 2)


def _records(lines: DataFrame) -> DataFrame:
    """(_file, _at, _record) of every record but each file's first, its heading."""
    split, file = Window.partitionBy("_file", "_block").orderBy("_at"), Window.partitionBy("_file").orderBy("_block")
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    rows = _ways(lines).withColumn("_flips", F.sum("_flip").over(split.rowsBetween(*upto)))
    # what each split does to the bit, and from there the bit it begins with
    whole = rows.groupBy("_file", "_block").agg(
        F.max(F.when(F.col("_set").isNotNull(), F.struct("_at", "_set", "_flips"))).alias("_last"), F.max("_flips").alias("_all"), F.min("_at").alias("_head"))
    whole = whole.select("_file", "_block", "_head", F.when(F.col("_last").isNotNull(), (F.col("_last._set") + F.col("_all") - F.col("_last._flips")) % 2).alias("_set"),
                         F.when(F.col("_last").isNull(), F.col("_all") % 2).otherwise(0).alias("_flip"))
    whole = whole.withColumn("_flips", F.sum("_flip").over(file.rowsBetween(*upto)))
    carried = whole.select("_file", "_block", F.first("_head").over(file.rowsBetween(*upto)).alias("_head"),
                           _bit(file.rowsBetween(*before), F.lit(0)).alias("_carry"))
    rows = rows.join(carried, ["_file", "_block"])
    rows = rows.withColumn("_inside", _bit(split.rowsBetween(*before), F.col("_carry"))).withColumn("_open", _bit(split.rowsBetween(*upto), F.col("_carry")))
    rows = rows.select("_file", "_block", "_at", "_head", "_line", "_inside", "_open")
    single = rows.where("_inside = 0 AND _open = 0 AND _at <> _head").select("_file", "_at", F.col("_line").alias("_record"))
    # lines of a record of several belong to the last beginning before them, which may be in an earlier split
    begins = F.when(F.col("_inside") == 0, F.col("_at"))
    firsts = rows.groupBy("_file", "_block").agg(F.max(begins).alias("_begin"))
    firsts = firsts.select("_file", "_block", F.last("_begin", ignorenulls=True).over(file.rowsBetween(*before)).alias("_earlier"))
    own = rows.withColumn("_own", F.last(begins, ignorenulls=True).over(split.rowsBetween(*upto))).where("_inside = 1 OR _open = 1")
    several = (own.join(firsts, ["_file", "_block"]).groupBy("_file", "_head", F.coalesce("_own", "_earlier").alias("_first"))
               .agg(F.sort_array(F.collect_list(F.struct("_at", "_line"))).alias("_lines"))
               .where("_first <> _head").select("_file", F.col("_first").alias("_at"), F.array_join("_lines._line", "\n").alias("_record")))
    return single.unionByName(several).withColumn("_record", F.regexp_replace("_record", r"\r\z", ""))


def _header(spark: SparkSession, file: str, encoding: str) -> list[str]:
    """Column names of a file: its first record; unnamed and repeated columns get
    their number."""
    n = 16
    while True:
        head = [r["value"] for r in spark.read.options(lineSep="\n", encoding=encoding).text(file).limit(n).collect()]
        text = "\n".join(head).removeprefix("﻿")
        names = next(csv.reader(x + "\n" for x in text.split("\n")), [])
        closed = len(head) < n or not names or not names[-1].endswith(head[-1].rstrip("\r") + "\n")
        if closed:
            break
        n *= 16                          # a heading of very many lines
    lower = [x.lower() for x in names]
    return [f"_c{i}" if not x else f"{x}{i}" if lower.count(x.lower()) > 1 else x for i, x in enumerate(names)]


def read_import_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The rows of a file, or of all files of a folder, with ``ord``; columns are
    named by the first file's heading."""
    names = sorted(spark.read.text(path).inputFiles())
    header = _header(spark, names[0], encoding) if names else []
    records = _records(_lines(spark, path, encoding))
    cells = records.where("_record <> ''").select("_file", "_at", F.from_csv("_record", _ddl(header), {"escape": '"', "maxCharsPerColumn": "-1"}).alias("_cells"))
    # one row per file
    numbers = spark.createDataFrame(list(enumerate(names)), "_no long, _file string")
    return (cells.join(F.broadcast(numbers), "_file")
            .select(*[F.col("_cells")[c].alias(c) for c in header], (F.col("_no") * FILE_STRIDE + F.col("_at")).alias("ord")))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
