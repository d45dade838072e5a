"""Free-text search of the committed leads table through a posting table.

``build`` writes, beside every data folder of the current version that has none
yet, which leads hold which run of three characters in any of the seven search
columns (lower case): (gram, ids), sorted by gram, so that Parquet statistics
leave out what a query does not ask for. Data folders never change, so neither
do their postings: an append or a rewrite only indexes the folders it has written. A
posting is bounded by the ids of a bucket.

``search_committed`` takes from a query the runs that every match must hold
(``required``), finds the leads that hold them all for one of the query's
alternatives, and tests those exactly as ``filters.search`` does. A query that
requires no run of three characters scans the table, and so do folders
without postings. Results are those of the scan in every case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SEARCH_COLUMNS
from ..operators.filters import GRAM, _grams, search
from .leads import _names, _read, current

POSTINGS = "gram string, ids array<long>"


def _place(root: str, folder: str) -> str:
    """Where the postings of a data folder are."""
    return f"{root}/_grams/" + "/".join(folder.rstrip("/").split("/")[-2:])


def _indexed(spark: SparkSession, root: str, folder: str) -> bool:
    return "_SUCCESS" in _names(spark, _place(root, folder))


def build(spark: SparkSession, root: str) -> int:
    """Index the folders of the current version that are not yet; returns their
    number. A failed build leaves a folder without its mark, to be built again."""
    root = root.rstrip("/")
    todo = [f for f in current(spark, root)[1] if not _indexed(spark, root, f)]
    for folder in todo:                  # one job a bucket: its leads are the unit of work
        leads = _read(spark, [folder])
        held = F.array_distinct(F.flatten(F.array(*[_grams(F.lower(F.coalesce(F.col(c), F.lit(""))), GRAM) for c in SEARCH_COLUMNS])))
        rows = leads.select("id", F.explode(held).alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        rows.sortWithinPartitions("gram").write.mode("overwrite").parquet(_place(root, folder))
    return len(todo)


def required(query: str, literal: bool = False) -> list[list[str]] | None:
    """Per alternative of a query (lower-cased; a regex unless ``literal``), the
    runs of three characters that each of its matches holds; None where one
    requires none, or where the query has groups."""
    q = query.lower()
    if literal:
        alternatives = [[q]]
    elif "(" in q:
        return None
    else:
        alternatives, runs, run, i = [], [], "", 0

        def end():
            nonlocal run
            runs.append(run)
            run = ""
        while i < len(q):
            c = q[i]
            if c == "|":
                end()
                alternatives.append(runs)
                runs = []
            elif c == "\\":
                i += 1
                if i < len(q) and not q[i].isalnum():
                    run += q[i]                                  # an escaped sign is itself
                else:
                    return None                                  # a class, a boundary, a quotation
            elif c == "[":
                end()
                close = q.find("]", i + 2)
                if close < 0 or q.startswith(("]", "^]"), i + 1) or "[" in q[i + 1:close] or "\\" in q[i:close] or "&&" in q[i:close]:
                    return None
                i = close
            elif c in "*?{":                                     # what was last may be missing
                run = run[:-1]
                end()
                if c == "{":
                    i = q.find("}", i)
                    if i < 0:
                        return None
            elif c in "+.^$":
                end()
            else:
                run += c
            i += 1
        end()
        alternatives.append(runs)
    grams = [sorted({r[k:k + GRAM] for r in runs for k in range(len(r) - GRAM + 1)}) for runs in alternatives]
    return grams if all(grams) else None


def candidates(spark: SparkSession, root: str, folders: list[str], grams: list[list[str]]) -> DataFrame:
    """Distinct ids of the leads in ``folders`` that hold all runs of an
    alternative."""
    postings = spark.read.schema(POSTINGS).parquet(*[_place(root, f) for f in folders])
    wanted = sorted({g for a in grams for g in a})
    found = postings.where(F.col("gram").isin(wanted)).select("gram", F.explode("ids").alias("id"))
    # one count per alternative, added up before the shuffle
    counts = found.groupBy("id").agg(*[F.count_if(F.col("gram").isin(a)).alias(f"_{i}") for i, a in enumerate(grams)])
    some = F.lit(False)
    for i, a in enumerate(grams):
        some = some | (F.col(f"_{i}") == len(a))
    return counts.where(some).select("id")


def search_committed(spark: SparkSession, root: str, query: str, literal: bool = False) -> DataFrame:
    """``filters.search`` over the committed table."""
    root = root.rstrip("/")
    folders = current(spark, root)[1]
    grams = required(query, literal) if query else None
    ready = [f for f in folders if grams and _indexed(spark, root, f)]
    rest = [f for f in folders if f not in set(ready)]
    out = search(_read(spark, rest), query, literal)
    if ready:
        ids = candidates(spark, root, ready, grams)
        out = out.unionByName(search(_read(spark, ready).join(ids, "id", "left_semi"), query, literal))
    return out
