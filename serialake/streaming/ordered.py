"""Machines that need a key's rows in time order, in constant memory.

A micro-batch is a table, so Spark sorts it (spilling where it must) by key and time behind the state the key was left in, and a
machine walks the sorted rows with a short list of times per key. New states and emitted rows are written together in a folder per
batch, so a replayed batch replaces itself and reads the state its predecessor left. A state whose times are older than any row can
still ask for is not written again: that is its expiry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SECOND = 1_000_000
FLUSH = 50_000  # rows of an output batch

#: (times kept, time of a row) -> (times kept, number to emit or None); times are microseconds.
Machine = Callable[[list[int], int], tuple[list[int], int | None]]


def debounced(width: int, kept: list[int], at: int) -> tuple[list[int], int | None]:
    """Pass a row ``width`` or more after the last one that passed."""
    return (kept, None) if kept and at - kept[-1] < width else ([at], 1)


def alerting(width: int, threshold: int, kept: list[int], at: int) -> tuple[list[int], int | None]:
    """Emit at ``threshold`` rows less than ``width`` old, then start over; fewer than ``threshold`` times are kept."""
    kept = [t for t in kept if at - t < width] + [at]
    return ([], len(kept)) if len(kept) >= threshold else (kept, None)


def _walk(machine: Machine, oldest: int, key_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, old, kept, at) in order, the state of a key first; gives emitted rows and the states with a time after ``oldest``."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        keys, kinds, times, numbers, states = zip(*out) if out else ((),) * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(kinds, pa.string()), pa.array(times, pa.int64()), pa.array(numbers, pa.int64()), pa.array(states, pa.list_(pa.int64()))],
                                          ["key", "kind", "at", "n", "kept"])

    for key, members in groupby(rows, key=lambda row: row[0]):
        kept: list[int] = []
        for _, old, state, at in members:
            if old:
                kept = list(state)
                continue
            kept, n = machine(kept, at)
            if n is not None:
                out.append((key, "out", at, n, None))
                if len(out) >= FLUSH:
                    yield flush()
        if kept and kept[-1] > oldest:
            out.append((key, "state", None, None, kept))
    if out:
        yield flush()


class OrderedSink:
    """``foreachBatch`` writer that runs a machine over the rows of every key in time order.

    ``width`` is how far back the machine looks; with ``lateness`` a row may be that much (both in microseconds) older
    than the newest one without finding its key's state expired. Rows without a key or a time are left out.
    """

    def __init__(self, root: str, machine: Machine, *, key: str, time: str, width: int, lateness: int = 0):
        self.root, self.machine, self.key, self.time, self.width, self.lateness = root, machine, key, time, width, lateness

    def _schema(self, key_type: T.DataType) -> T.StructType:
        return T.StructType([T.StructField("key", key_type), T.StructField("kind", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
                             T.StructField("kept", T.ArrayType(T.LongType()))])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, key_type = batch.sparkSession, batch.schema[self.key].dataType
        rows = batch.select(F.col(self.key).alias("key"), F.lit(False).alias("old"), F.lit(None).cast("array<bigint>").alias("kept"),
                            F.unix_micros(F.col(self.time).cast("timestamp")).alias("at")).where("key is not null and at is not null")
        if batch_id:
            rows = rows.unionByName(self.states(spark, key_type, batch_id - 1).select("key", F.lit(True).alias("old"), "kept", F.lit(None).cast("bigint").alias("at")))
        newest = batch.select(F.max(F.unix_micros(F.col(self.time).cast("timestamp")))).first()[0]
        oldest = 0 if newest is None else newest - self.width - self.lateness
        ordered = rows.repartition("key").sortWithinPartitions("key", F.col("old").desc(), "at")
        walked = ordered.mapInArrow(partial(_walk, self.machine, oldest, to_arrow_type(key_type)), self._schema(key_type))
        walked.write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/batch={batch_id}")
        if batch_id > 1:  # a replay reads the batch before it, never an older one
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={batch_id - 2}/kind=state")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def states(self, spark: SparkSession, key_type: T.DataType, batch_id: int) -> DataFrame:
        """key, kept: the states that a batch left."""
        return spark.read.schema(self._schema(key_type)).parquet(f"{self.root}/batch={batch_id}").where("kind = 'state'").select("key", "kept")

    def emitted(self, spark: SparkSession, key_type: T.DataType, number: str = "n") -> DataFrame:
        """Emitted rows of all batches: key, time and the machine's number."""
        found = spark.read.schema(self._schema(key_type)).parquet(self.root).where("kind = 'out'")
        return found.select(F.col("key").alias(self.key), F.timestamp_micros("at").alias(self.time), F.col("n").alias(number))


def debounce_sink(root: str, *, key: str, time: str, seconds: float = 2.0, lateness: float = 0) -> OrderedSink:
    """Leading-edge debounce: a row passes ``seconds`` or more after the last row of its key that passed."""
    width = int(seconds * SECOND)
    return OrderedSink(root, partial(debounced, width), key=key, time=time, width=width, lateness=int(lateness * SECOND))


def suppress_sink(root: str, *, key: str, time: str, seconds: float = 300, lateness: float = 0) -> OrderedSink:
    """A repeat of the key less than ``seconds`` after the last row that passed is dropped; keys expire after that time.

    The result does not depend on how the stream is cut into batches as long as the rows of a key come in time order.
    """
    return debounce_sink(root, key=key, time=time, seconds=seconds, lateness=lateness)


def alert_sink(root: str, *, pool: str, time: str, seconds: float = 60, threshold: int = 10, lateness: float = 0) -> OrderedSink:
    """An alert when a pool has ``threshold`` bans less than ``seconds`` old, then its count starts over."""
    width = int(seconds * SECOND)
    return OrderedSink(root, partial(alerting, width, threshold), key=pool, time=time, width=width, lateness=int(lateness * SECOND))
