"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, executor sizing) belong to whoever submits
the job; these helpers only fill in what is missing, so tests and the local bench get sane
defaults while a cluster keeps its own configuration.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query in this package relies on. They are session-level SQL settings, so they
# are safe to (re)apply on an existing session.
_SQL_DEFAULTS = {
    # All source timestamps are timezone-free; pin UTC so date arithmetic never depends on the
    # host.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Task sizes. Spark's own (128 MB of Parquet, 64 MB of compressed shuffle data) are about 1 GB of rows in a sort,
# more than an executor's core has; with these, tasks stay in memory and more input means more tasks.
_TASK_SIZES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}
#: Shuffles of the marts start with one partition per so many bytes of input files, or the cluster's number, if that is larger.
PARTITION_BYTES = 4 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def ensure_defaults(spark: SparkSession) -> SparkSession:
    for key, value in _SQL_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def size_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Task sizes for a job over so many bytes of input files; what the cluster or the caller has set stays.

    Small shuffles are coalesced again at run time, so that a larger number of partitions costs nothing there.
    """
    given = spark.conf.getAll
    for key, value in _TASK_SIZES.items():
        if key not in given:
            spark.conf.set(key, value)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_PARTITIONS, str(max(least, -(-input_bytes // PARTITION_BYTES))))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (the grouped-map
    scorer runs there): zip it once per application and add it like ``--py-files``."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    staging = tempfile.mkdtemp(prefix="kpiforge-pyfiles-")
    archive = shutil.make_archive(
        os.path.join(staging, pkg.name), "zip", root_dir=pkg.parent, base_dir=pkg.name
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when a local session has none (tests) a scratch folder is created and registered; on a
    cluster, where executors do not share local folders, a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="kpiforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kpiforge") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_defaults(spark)
