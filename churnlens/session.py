"""Spark session helpers.

The library never picks a machine-local scratch folder on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. Only a local-mode session (tests, bench) gets a private
temporary folder when that setting is missing.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "churnlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for the library: AQE on, UTC, UI off, Arrow batches."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call sites in column expressions: they cost milliseconds each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CHURNLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the session.

    Reads ``spark.checkpoint.dir``; if the SparkContext has none yet, applies it.
    Only when the setting is absent *and* the master is local does this create a
    private temporary folder (the test/bench situation). On a cluster without the
    setting it raises instead of silently using executor-local disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so checkpoints survive executor loss")
        configured = tempfile.mkdtemp(prefix="churnlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
