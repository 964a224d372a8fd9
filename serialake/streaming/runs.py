"""Run a stream over what is available now and return its output as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without one uses a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="serialake-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, *, name: str, folder: str | None = None) -> DataFrame:
    """Write the stream to a folder with ``availableNow`` and read it back; a folder used before goes on where its last run ended."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
                 .outputMode("append").trigger(availableNow=True).start(f"{folder}/out"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, write, *, name: str) -> str:
    """Feed the stream to a ``foreachBatch`` writer with ``availableNow``; returns the checkpoint folder."""
    folder = work_folder(stream.sparkSession, name)
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return folder
