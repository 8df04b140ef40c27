"""Session settings, and the shared folder for staged tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# What the plans count on. AQE sizes the shuffles and splits a hot key of the
# line-entry join (Spark defaults, stated). It also saves that join its sort where
# every partition of the entries is small enough to hash; larger ones are merged.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # A report of one year needs the lines of that year's entries only. On a ledger whose lines do not
    # store the year, a Bloom filter of the entries drops most other lines before the shuffle. Its size is
    # bounded (runtime.bloomFilter.maxNumBits); building it scans the entries once more, which pays
    # where the lines are read from gigabytes. Beyond some ten million entries a year it lets ever more
    # lines through: such a ledger is better stored with save_ledger.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100GB",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **settings) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass in the cluster's own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("finstat")
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        **settings,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a local session uses one under the system's temporary folder. A
    cluster session does not: its executors would not see the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "finstat")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
