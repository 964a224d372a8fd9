"""Failure machine (J4) as a stream, and batch twins of J4 to J6 where aggregates and windows can say it.

The counting machine combines before its shuffle: of every Arrow batch only the earliest ``cap``
rows per key travel, so a hot key cannot flood the task that holds its state. Machines with timers are
in ``timers``, those that need sorted rows in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from serialake.operators.ordering import keep_top
from serialake.operators.running import position


def _earliest(rows: Iterator[pd.DataFrame], time: str, n: int) -> list:
    """The ``n`` smallest times, merged while the chunks pass by."""
    kept: list = []
    for pdf in rows:
        kept = sorted([*kept, *pdf[time].nsmallest(n)])[:n]
    return kept


class CapReached(StatefulProcessor):
    """Count rows per key and emit one row when the cap is reached, never again."""

    def __init__(self, key: str, time: str, cap: int):
        self.key, self.time, self.cap = key, time, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.count.get()[0] if self.count.exists() else 0
        if seen >= self.cap:
            return
        earliest = _earliest(rows, self.time, self.cap - seen)
        self.count.update((seen + len(earliest),))
        if seen + len(earliest) >= self.cap:
            yield pd.DataFrame({self.key: [key[0]], self.time: [earliest[-1]], "failures": [self.cap]})

    def close(self) -> None:
        pass


def _earliest_per_batch(key: str, time: str, cap: int):
    """Arrow-batch combiner: nothing beyond the earliest ``cap`` rows of a key can matter to the cap-th one."""
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(time, kind="stable").groupby(key, sort=False).head(cap)
    return combine


def dead_keys(failures: DataFrame, *, key: str, time: str, cap: int) -> DataFrame:
    """Stream of failures to one DEAD row per key, at its cap-th failure. Input holds failures only."""
    key_field, time_field = T.StructField(key, failures.schema[key].dataType), T.StructField(time, T.TimestampType())
    stamped = failures.select(key, F.col(time).cast("timestamp").alias(time))
    combined = stamped.mapInPandas(_earliest_per_batch(key, time, cap), T.StructType([key_field, time_field]))
    schema = T.StructType([key_field, time_field, T.StructField("failures", T.LongType())])
    return combined.groupBy(key).transformWithStateInPandas(
        statefulProcessor=CapReached(key, time, cap), outputStructType=schema, outputMode="Append", timeMode="None")


def dead_keys_batch(failures: DataFrame, *, key: str, time: str, tie: str, cap: int) -> DataFrame:
    """J4/F9 twin: the cap-th failure of every key that has one (rank-limited before the shuffle)."""
    top = keep_top(failures, key=[key], order=[time, tie], k=cap)
    return top.groupBy(key).agg(F.count("*").alias("failures"), F.max(time).alias(time)).where(F.col("failures") >= cap)


def bans_batch(failures: DataFrame, *, key: str, time: str, tie: str, cap: int = 3, pools: DataFrame | None = None, pool: str = "pool", size: str = "size",
               exempt: Column | None = None) -> DataFrame:
    """J5 twin: ban time per key: its ``cap``-th failure, unless the key is exempt (a null test is no exemption).

    With ``pools`` (pool, size) a pool keeps its last member: the first ``size - 1`` keys to get there are banned, ties by key. A key
    belongs to one pool; a pool without a row has no member to ban.
    """
    counted = failures if exempt is None else failures.where(~F.coalesce(exempt, F.lit(False)))
    banned = dead_keys_batch(counted, key=key, time=time, tie=tie, cap=cap)
    if pools is None:
        return banned
    members = counted.groupBy(key).agg(F.min(pool).alias(pool))
    ranked = position(banned.join(members, key), key=[pool], order=[time, key], name="__turn", start=1)
    return ranked.join(pools.select(pool, F.col(size).alias("__size")), pool).where(F.col("__turn") < F.col("__size")).drop("__turn", "__size")


def cooldowns(failures: DataFrame, *, key: str, time: str, seconds: int = 60) -> DataFrame:
    """When each key may be used again: last failure plus the cooldown."""
    last = failures.groupBy(key).agg(F.max(time).alias("last_failure"))
    return last.withColumn("available_at", F.col("last_failure") + F.make_dt_interval(secs=F.lit(seconds)))


def trailing_counts(rows: DataFrame, *, time: str, seconds: int, pool: str | None = None) -> DataFrame:
    """J6 twin: for each row the rows of its pool less than ``seconds`` old, itself included (no reset).

    Time is cut into blocks as wide as the look-back; every row also visits the next block as context,
    so a window never spans more than two blocks. Within a block the count is a running sum: rows of the block come in
    at their time, those of the block before are there from the start and go when they are ``seconds`` old.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    own = F.floor(at / width)
    spread = rows.withColumn("__at", at).withColumn("__own", own).withColumn("__block", F.explode(F.array(own, own + 1)))
    context = F.col("__own") < F.col("__block")
    block = W.partitionBy(*([pool] if pool else []), "__block")
    so_far = block.orderBy(F.col("__at") + F.when(context, width).otherwise(0)).rangeBetween(W.unboundedPreceding, 0)
    counted = spread.withColumn("recent", F.sum(F.when(context, -1).otherwise(1)).over(so_far) + F.count(F.when(context, 1)).over(block))
    return counted.where(F.col("__own") == F.col("__block")).drop("__at", "__own", "__block")
