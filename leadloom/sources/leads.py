"""The leads table: fixture frame, snapshot scan and snapshot sink.

Every mutation is a ``leads -> leads'`` transform. A table lives below a root
folder, laid out in buckets of ``BUCKET_IDS`` consecutive ids; a commit is one small
record (version, the folders of every bucket, high-water marks of the ids given
out). ``commit`` writes a whole version or, with ``append``, adds new rows to the
current one; ``rewrite`` changes some leads and writes the buckets that hold them
only (copy on write), all others are carried over in the record. Folders
that readers use are never written again, so a failed or retried job leaves the
current version intact.

A record appears under its version's name complete or not at all, and only if
no other has that name: of jobs that commit the same version one succeeds, the
others get ``CommitConflict`` and can start again from the new version. This
rests on a link that fails where the name exists (local and shared POSIX
folders) or a rename that does (HDFS and like stores).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify_phone
from ..schemas import LEADS, conform_leads
from .fixtures import fixture

# Fixed creation time of fixture rows (jobs take ``as_of`` as an argument so
# runs are repeatable).
FIXTURE_AS_OF = _dt.datetime(2026, 1, 1, 0, 0, 0)


def fixture_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "leads_raw")
    return conform_leads(raw.withColumn("phone_type", classify_phone("phone")), FIXTURE_AS_OF)


COMMITS = "version long, folders array<string>, marks map<string,long>"
BUCKET_IDS = 1 << 20
_BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another job committed this version first."""


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    p, fs = _store(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def current(spark: SparkSession, root: str) -> tuple[int, list[str], dict[str, int]]:
    """(version, bucket folders, marks) of the latest commit; (0, [], {}) before
    the first."""
    records = f"{root.rstrip('/')}/_commits"
    versions = [n for n in _names(spark, records) if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return 0, [], {}
    last = spark.read.schema(COMMITS).json(f"{records}/{max(versions)}").first()
    return last["version"], list(last["folders"]), dict(last["marks"] or {})


def _publish(spark: SparkSession, root: str, record: tuple) -> int:
    """Make the record visible under its version's name if that is free."""
    version = record[0]
    records, label = f"{root}/_commits", uuid.uuid4().hex[:12]
    tmp, name = f"{records}/_tmp-{label}", f"{records}/{version:012d}.json"
    spark.createDataFrame([record], COMMITS).coalesce(1).write.mode("errorifexists").json(tmp)
    part = next(n for n in _names(spark, tmp) if n.startswith("part-"))
    (source, fs), (target, _), (folder, _) = _store(spark, f"{tmp}/{part}"), _store(spark, name), _store(spark, tmp)
    try:
        if fs.getScheme() == "file":
            to_file = lambda p: spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark.sparkContext._jvm.java.nio.file.Files.createLink(to_file(target), to_file(source))
        elif fs.exists(target) or not fs.rename(source, target):
            raise CommitConflict(f"version {version} of {root} exists")
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise CommitConflict(f"version {version} of {root} exists") from None
        raise
    finally:
        fs.delete(folder, True)
    return version


def _write(rows: DataFrame, root: str) -> list[str]:
    """Write rows in buckets below a new folder; the buckets' folders."""
    spark = rows.sparkSession
    folder = f"{root}/data-{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    # a bucket is a range of ids: one task writes one file of it
    (rows.withColumn(_BUCKET, F.floor(F.col("id") / BUCKET_IDS).cast("long")).repartition(_BUCKET)
     .write.mode("errorifexists").partitionBy(_BUCKET).parquet(folder))
    return [f"{folder}/{n}" for n in sorted(_names(spark, folder)) if n.startswith(f"{_BUCKET}=")]


def _bucket_of(folder: str) -> int:
    return int(folder.rsplit(f"{_BUCKET}=", 1)[1])


def _raised(stored: dict[str, int], marks: dict[str, int] | None) -> dict[str, int]:
    return {**stored, **{k: max(v, stored.get(k, 0)) for k, v in (marks or {}).items()}}


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(LEADS).parquet(*folders) if folders else spark.createDataFrame([], LEADS)


def scan_leads(spark: SparkSession, root: str) -> DataFrame:
    """Scan of the latest committed version (filters and projections push into
    the scan)."""
    version, folders, _ = current(spark, root)
    if not version:
        raise FileNotFoundError(f"no version committed below {root}")
    return _read(spark, folders)


def newest_first(leads: DataFrame) -> DataFrame:
    """All leads, newest id first (apply only at the sink)."""
    return leads.orderBy(F.col("id").desc())


def newest_page(spark: SparkSession, root: str, size: int, before: int | None = None) -> DataFrame:
    """The ``size`` newest leads with an id below ``before`` (all ids if None),
    newest first. Buckets are read from the newest on, twice as many each time,
    until the page is full: what is read follows the page, not the table."""
    folders = current(spark, root)[1]
    buckets = sorted({b for f in folders if (b := _bucket_of(f)) * BUCKET_IDS < (before if before is not None else float("inf"))}, reverse=True)
    n = 1
    while True:
        rows = _read(spark, [f for f in folders if _bucket_of(f) in set(buckets[:n])])
        rows = rows if before is None else rows.where(F.col("id") < before)
        if n >= len(buckets) or rows.select("id").limit(size).count() >= size:
            return newest_first(rows).limit(size)
        n *= 2


def marks_after(marks: dict[str, int] | None, **tables: DataFrame) -> dict[str, int]:
    """High-water marks of the ids given out: the stored ones, raised to the
    highest id of each table."""
    out = dict(marks or {})
    for name, df in tables.items():
        out[name] = max(out.get(name, 0), df.agg(F.max("id")).first()[0] or 0)
    return out


def commit(rows: DataFrame, root: str, append: bool = False, marks: dict[str, int] | None = None, base: int | None = None) -> int:
    """Write ``rows`` as the next version (with ``append``: add them to the
    current one, writing only the new rows); returns the version. Marks never
    fall below the stored ones. ``base``: the version that the rows were made
    from; where another has been committed since, ``CommitConflict``."""
    spark, root = rows.sparkSession, root.rstrip("/")
    version, folders, stored = current(spark, root)
    if base is not None and base != version:
        raise CommitConflict(f"{root} is at version {version}, the rows were made from {base}")
    new = _write(rows, root)
    return _publish(spark, root, (version + 1, [*(folders if append else []), *new], _raised(stored, marks)))


def rewrite(spark: SparkSession, root: str, touched: DataFrame | Column, change, marks: dict[str, int] | None = None,
            base: int | None = None) -> tuple[int, int]:
    """Change some leads and commit: ``change`` is a ``leads -> leads'`` transform
    that alters or drops leads among ``touched`` only (a frame with ``id``, or a
    condition on leads). The buckets that hold them are read, changed and written;
    returns (version, buckets written). Nothing touched: no commit. ``base`` as in
    ``commit``."""
    root = root.rstrip("/")
    version, folders, stored = current(spark, root)
    if base is not None and base != version:
        raise CommitConflict(f"{root} is at version {version}, the change was made from {base}")
    by_bucket: dict[int, list[str]] = {}
    for f in folders:
        by_bucket.setdefault(_bucket_of(f), []).append(f)
    ids = touched if isinstance(touched, DataFrame) else _read(spark, folders).where(touched)
    # one row per bucket
    hit = {r[0] for r in ids.where("id is not null").select(F.floor(F.col("id") / BUCKET_IDS).cast("long")).distinct().collect()} & set(by_bucket)
    if not hit:
        return version, 0
    new = _write(change(_read(spark, [f for b in sorted(hit) for f in by_bucket[b]])), root)
    kept = [f for f in folders if _bucket_of(f) not in hit]
    return _publish(spark, root, (version + 1, [*kept, *new], _raised(stored, marks))), len(hit)
