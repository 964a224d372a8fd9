"""Session defaults shared by the entry module, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale. Partition counts are left to the cluster: AQE coalesces
# from a generous initial number, and local runs override it.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # HotSpot never compiles a method above 8,000 bytecodes; stages that would need one run unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the same semantics as the cluster one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("serialake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small local data: keep the cores busy instead of merging everything into one partition.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    # A local session has one machine; a cluster names a folder that every executor reaches.
    builder = builder.config("spark.checkpoint.dir", os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="serialake-checkpoint-"))
    for key, value in COMMON.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
