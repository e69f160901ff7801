"""Session helpers: a tuned local builder and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_ROOT: dict[str, str] = {}


def build_session(app: str = "candlemill", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only in local mode
    (tests, a laptop) is a folder of our own chosen; elsewhere a missing setting is an error, as
    executors would each write to their own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="spark-candlemill-", dir="/tmp")
    return _OWN_ROOT[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder, never reused, so that a re-run cannot read a stale table."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
