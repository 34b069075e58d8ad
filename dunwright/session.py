"""A local session for tests and the bench; clusters bring their own settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g", app: str = "dunwright") -> SparkSession:
    shared = tempfile.mkdtemp(prefix="dunwright-")  # one machine here, so all executors share it
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    session = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # small test tables: keep every core busy instead of merging into 1 MB partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session
