"""A Spark session with the settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "flowlens", cores: int | None = None, folder: str | None = None) -> SparkSession:
    """The running session, or a local one for tests and benchmarks.

    ``folder`` becomes the local session's warehouse, which also holds its intermediate tables.

    On a cluster the job's own session is used: shuffle partitions and memory come from its
    configuration, and AQE coalesces or splits partitions at run time.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    cores = cores or os.cpu_count() or 4
    folder = folder or os.path.abspath("spark-warehouse")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small inputs still use all local cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", folder)
        # a hot key's sessions combine before they are sent
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
