"""Spark session and checkpoint-directory helpers.

Library code never invents cluster paths: the checkpoint folder comes from the
session (``spark.checkpoint.dir`` or an already-set SparkContext checkpoint dir).
Only a *local-mode* session without that setting (tests, the bench) gets a fresh
scratch folder, made with ``mkdtemp``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tabeval", cores: int | str = "*", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABEVAL_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session config.

    Order: an already-set SparkContext dir, then ``spark.checkpoint.dir``; a
    local-mode session with neither gets a fresh ``mkdtemp`` folder (tests).
    On a cluster without the setting we refuse rather than write to a
    machine-local folder that executors cannot share.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        d = tempfile.mkdtemp(prefix="tabeval-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this cluster")


def drop_frozen(spark: SparkSession) -> int:
    """Housekeeping for callers: delete the ``tabeval-*`` tables this package
    froze under the session's checkpoint folder (Hadoop FileSystem API, so it
    works on HDFS/S3/ABFS). Call it only after every result that may still read
    them has been written. Returns the number of folders removed."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        return 0
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    removed = 0
    for st in fs.listStatus(path):
        if st.getPath().getName().startswith("tabeval-"):
            fs.delete(st.getPath(), True)
            removed += 1
    return removed
