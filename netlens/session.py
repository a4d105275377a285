"""Session settings shared by the tests, the bench and local runs.

On a cluster the caller brings its own session; nothing here is needed there, because no
operator depends on a setting beyond Spark's defaults (the stateful streams name theirs).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "netlens", cpus: str | None = None, partitions: int | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS") or "8"
    width = partitions or (int(cores) if cores.isdigit() else 8)
    # Generated methods above 8000 bytecodes are never compiled by the JVM; the limit makes Spark split
    # such wide projections into small methods instead.
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, fallback: str) -> str:
    """The shared folder the cluster names; ``fallback`` only in a local session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or fallback
