"""Job messages and logs as streams. The transport is a parameter; the payload is JSON.

With a broker, pass ``format="kafka"`` and add ``org.apache.spark:spark-sql-kafka-0-10`` to the
session packages; files of JSON lines work the same way (``format="text"``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.sources import growing


def read_messages(spark: SparkSession, *, format: str = "kafka", options: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """A5: stream with one string column ``value``, from the earliest offset unless told otherwise."""
    reader = spark.readStream.format(format)
    defaults = {"startingOffsets": "earliest"} if format == "kafka" else {}
    for name, value in (defaults | (options or {})).items():
        reader = reader.option(name, value)
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("value"))


def job_messages(jobs: DataFrame, *, columns: list[str] | None = None) -> DataFrame:
    """Rows as JSON payloads; a job without any field is rejected."""
    names = columns or jobs.columns
    some = F.coalesce(*[F.col(c).cast("string") for c in names])
    return jobs.where(some.isNotNull()).select(F.to_json(F.struct(*names)).alias("value"))


def is_acceptable(value: Column) -> Column:
    """The payload is a JSON object with at least one field."""
    keys = F.json_object_keys(value)
    return F.coalesce(F.size(keys) > 0, F.lit(False))


def write_messages(messages: DataFrame, *, format: str = "kafka", checkpoint: str, options: dict[str, str] | None = None, path: str | None = None):
    """Start the sink query; a broker acknowledges with ``acks=all``."""
    writer = messages.writeStream.format(format).option("checkpointLocation", checkpoint)
    defaults = {"kafka.acks": "all"} if format == "kafka" else {}
    for name, value in (defaults | (options or {})).items():
        writer = writer.option(name, value)
    return writer.start(path) if path else writer.start()


def tail_log(spark: SparkSession, path: str, *, since: str | None = None, glob: str = "*", from_start: bool = True, split_bytes: int = 32 << 20) -> DataFrame:
    """Lines of the log files of a folder as a stream (line, file, position), those appended later too, each once.

    Files may grow, be renamed by a rotation, be truncated or replaced (see ``growing``). ``since`` (timestamp text, UTC) leaves out files
    last written before it; without ``from_start`` only lines written after the query began are read. The last line of a file is read
    when its line feed is there.
    """
    growing.register(spark)
    reader = spark.readStream.format("growing_log").option("glob", glob).option("splitBytes", str(split_bytes))
    reader = reader.option("startingOffsets", "earliest" if from_start else "latest")
    if since is not None:
        reader = reader.option("since", str(dt.datetime.fromisoformat(since).replace(tzinfo=dt.timezone.utc).timestamp()))
    return reader.load(path)
