"""Session builder with the settings the jobs are tuned for.

Nothing in the library depends on this builder: every operator takes the
DataFrames it is given and the caller's session.  It only collects the settings
that matter at scale in one place.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any size.  AQE re-plans joins and partition counts from
#: real sizes; the skew rule splits a hot site even where that costs a shuffle;
#: small Arrow batches keep a batch of multi-megabyte documents inside a worker.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": "64m",
    # Call-site capture costs milliseconds for every column expression built in Python.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(name: str = "lucidex", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with :data:`SETTINGS`; *master* is only for local runs."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", os.environ.get("LUCIDEX_DRIVER_MEMORY", "12g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
