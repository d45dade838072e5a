"""Session helpers.

Cluster jobs get their settings from the cluster; ``get_spark`` only fills
in what is unset so the same code runs in tests on ``local[N]``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "leadloom", cpus: int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench (cluster runs pass their own)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in _LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is never
    overridden here. Only when it is unset and the master is local (tests) a
    scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:          # remote sessions: the server's configuration decides
        return spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:        # already chosen for this context
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="leadloom-ckpt-")
    sc.setCheckpointDir(d)
    return d


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` in the shared folder named by
    ``spark.checkpoint.dir`` (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
