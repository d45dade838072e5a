"""Helpers shared by the training-data operators.

``stage`` cuts lineage with a Parquet table in the shared folder that the
session names in ``spark.checkpoint.dir``; every task that reads it again after
a lost executor reads files, not recomputed shuffles.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

U64 = np.uint64
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table of a scale-factor folder (any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/leadloom-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more (iterations replace
    theirs). Files of other origin are left alone."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for d in folders:
        if "/leadloom-" in d:
            p = jvm.org.apache.hadoop.fs.Path(d)
            p.getFileSystem(conf).delete(p, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished jobs."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def private(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns added on the way."""
    p = "_own"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def schema_ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: rows of an Arrow batch: rows are whole documents, so a batch is a few MB
BATCH_ROWS = 1000


def release() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers for
    later tasks, other operators' among them."""
    import ctypes
    import gc
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim is not None:
        trim(0)


def map_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows (a setting of
    the session, lowered where it is larger); a task that ends gives its memory
    back."""
    def whole(batches):
        yield from run(batches)
        release()

    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(whole, schema)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """Number of blocks so that one block holds about ``block_bytes``."""
    return max(1, -(-int(total_bytes) // int(block_bytes)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter-based generator (vectorised)."""
    x = x.astype(np.uint64, copy=True)
    x += MIX_A
    x ^= x >> U64(30)
    x *= MIX_B
    x ^= x >> U64(27)
    x *= MIX_C
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word; emptied when it
    holds ``limit`` words, which changes speed only, never a value."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hash of every ``width`` consecutive values, by
    doubling; empty when there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    out = np.zeros(n, dtype=np.uint64)
    power, done, cur, size = 1, 0, h, 1
    bits = width
    while bits:
        if bits & 1:
            # append this power-of-two piece after the ``done`` values covered so far
            out += cur[done:done + n] * U64(pow(base, done, 1 << 64))
            done += size
        bits >>= 1
        if bits:
            power = pow(base, size, 1 << 64)
            cur = cur[:-size] + cur[size:] * U64(power)
            size *= 2
    return out


def binary_column(batch, name: str) -> list:
    """A string or binary column of an Arrow batch as a list of ``bytes``;
    null gives ``None``."""
    import pyarrow as pa
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()
