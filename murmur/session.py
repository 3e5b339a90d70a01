"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint directory) are taken from the
session when they are already set; defaults are applied only where a setting is
missing, which is the case in local tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A worker holds some copies of a batch of texts or vectors; rows alone don't bound its size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    # Broadcasts stay behind an explicit size bound; 32 MB is the largest
    # side we let the planner ship to every executor without being asked.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "murmur",
              shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply defaults that are not set yet, make sure a checkpoint dir exists
    and that Python workers can import this package."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application (what
    ``--py-files`` does), so Arrow-batch functions can be unpickled there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or "murmur" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        return                      # already shipped, or deployed with --py-files
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="murmur-pkg-")
    archive = shutil.make_archive(os.path.join(out, "murmur"), "zip", os.path.dirname(pkg), "murmur")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a shared filesystem path).  Only in local mode
    a scratch folder is created instead, and removed when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="murmur-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
