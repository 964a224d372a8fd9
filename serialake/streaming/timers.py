"""J5, J11 as streams: per-key state with event-time timers.

A timer stands for "nothing has happened until then": a cooldown that ran out, a retry that fell due. It fires when the watermark passes
it, or when a later row of the key shows that its time had come before. Times travel as microseconds; a key's rows of one micro-batch
are two arrays, and where rows can be merged before the shuffle (failures of one cooldown) only the merged ones travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000


def _timer(micros: int) -> int:
    """Milliseconds of a timer, never before the time it stands for."""
    return -(-micros // 1000)


def _collected(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    chunks = [[pdf[c].to_numpy() for c in columns] for pdf in rows]
    return [np.concatenate(c) for c in zip(*chunks)] if chunks else [np.zeros(0, np.int64) for _ in columns]


def _objects(values) -> pd.Series:
    """A column whose values Spark converts itself (text must not become an Arrow-backed column)."""
    return pd.Series(list(values), dtype=object)


def _stamp(values) -> pd.Series:
    return pd.to_datetime(pd.Series(values, dtype="int64"), unit="us")


# -- J5 ---------------------------------------------------------------------------------------------------------------

def merge_failures(key: list[str], cap: int, cooldown: int):
    """Arrow-batch combiner: of a key's failures the earliest ``cap`` one by one, the rest as stretches without a free cooldown in between."""
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values([*key, "first"], kind="stable").reset_index(drop=True)
            groups = pdf.groupby(key, sort=False, dropna=False)["first"]
            rank, gap = groups.cumcount(), groups.diff()
            begins = (rank <= cap) | gap.isna() | (gap >= cooldown)
            stretch = begins.cumsum()
            out = pdf.groupby(stretch, sort=False).agg({**{k: "first" for k in key}, "first": "min", "last": "max"})
            out["at"] = _stamp(out["last"].to_numpy()).to_numpy()
            yield out[[*key, "first", "last", "at"]]
    return combine


class KeyCooldown(StatefulProcessor):
    """Per (pool, key): the time of the ``cap``-th failure, and every time at which a cooldown ran out."""

    def __init__(self, cap: int, cooldown: int):
        self.cap, self.cooldown = cap, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", T.StructType([T.StructField("count", T.LongType()), T.StructField("last", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, last = self.state.get() if self.state.exists() else (0, None)
        before = last
        first, until = _collected(rows, "first", "last")
        order = np.lexsort((until, first))
        out = []
        for begin, end in zip(first[order].tolist(), until[order].tolist()):
            if last is not None and begin - last >= self.cooldown:
                out.append((last + self.cooldown, "usable"))
            last = end if last is None else max(last, end)
            count += 1
            if count == self.cap:
                out.append((begin, "strike"))
        self.state.update((min(count, self.cap), last))
        if before is not None and before != last:
            self.handle.deleteTimer(_timer(before + self.cooldown))
        if last is not None and before != last:
            self.handle.registerTimer(_timer(last + self.cooldown))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, last = self.state.get()
        self.state.update((count, None))
        if last is not None:
            yield self._rows(key, [(last + self.cooldown, "usable")])

    def _rows(self, key, found: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"pool": _objects([key[0]] * len(found)), "key": _objects([key[1]] * len(found)), "at": _stamp([t for t, _ in found]), "event": _objects(k for _, k in found)})

    def close(self) -> None:
        pass


class PoolBans(StatefulProcessor):
    """Per pool: a strike bans its key while more than one member is left; a banned key is never usable again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", T.StructType([T.StructField("n", T.LongType())]))
        self.banned = handle.getMapState("banned", T.StructType([T.StructField("key", T.StringType())]), T.StructType([T.StructField("at", T.LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.left.update((int(initialState["size"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.left.get()[0] if self.left.exists() else 0
        events = pd.concat(list(rows)).sort_values(["at", "event", "key"], kind="stable")
        kept = []
        for name, event in zip(events["key"], events["event"]):
            if event == "usable":
                kept.append(None if self.banned.containsKey((str(name),)) else "usable")
            elif left > 1:
                left -= 1
                self.banned.updateValue((str(name),), (left,))
                kept.append("ban")
            else:
                kept.append(None)
        self.left.update((left,))
        rows = [row for row in zip(events["pool"], events["key"], events["at"], kept) if row[3]]
        if rows:
            pools, keys, times, names = zip(*rows)
            yield pd.DataFrame({"pool": _objects(pools), "key": _objects(keys), "at": pd.Series(times), "event": _objects(names)})

    def close(self) -> None:
        pass


def ban_events(failures: DataFrame, pools: DataFrame, *, key: str, pool: str, time: str, size: str = "size", cap: int = 3, cooldown: float = 60, delay: str = "0 seconds",
               exempt: Column | None = None) -> DataFrame:
    """Stream of failures to ``event`` rows: a key's ``ban`` at its ``cap``-th failure, and ``usable`` when its cooldown ends.

    ``pools`` (pool, size) is the first state of the pools: a pool keeps its last member, and a pool without a row has none to ban.
    An exempt key (a null test is no exemption) has cooldowns and no ban. Every failure starts the cooldown anew. Rows more than
    ``delay`` behind the newest one are late and dropped.
    """
    micros, wait = F.unix_micros(F.col(time).cast("timestamp")), int(cooldown * SECOND)
    pool_type, key_type = failures.schema[pool].dataType, failures.schema[key].dataType
    spared = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    narrow = failures.select(F.col(pool).alias("pool"), F.col(key).alias("key"), spared.alias("spared"), micros.alias("first"), micros.alias("last"))
    fields = [T.StructField("pool", pool_type), T.StructField("key", key_type), T.StructField("spared", T.BooleanType())]
    merged = narrow.mapInPandas(merge_failures(["pool", "key", "spared"], cap, wait), T.StructType(
        [*fields, T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("at", T.TimestampType())])).withWatermark("at", delay)
    shape = T.StructType([*fields[:2], T.StructField("at", T.TimestampType()), T.StructField("event", T.StringType()), T.StructField("spared", T.BooleanType())])
    judged = merged.groupBy("pool", "key", "spared").transformWithStateInPandas(
        statefulProcessor=_Spared(cap, wait), outputStructType=shape, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
    struck = judged.where("not (spared and event = 'strike')").select("pool", "key", "at", "event")
    first = pools.select(F.col(pool).alias("pool"), F.col(size).cast("bigint").alias("size")).groupBy("pool")
    out = struck.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=PoolBans(), outputStructType=T.StructType(shape.fields[:4]), outputMode="Append", timeMode="None", initialState=first)
    return out.withColumnsRenamed({"pool": pool, "key": key, "at": time})


class _Spared(KeyCooldown):
    def _rows(self, key, found: list[tuple[int, str]]) -> pd.DataFrame:
        return super()._rows(key, found).assign(spared=bool(key[2]))


# -- J11 --------------------------------------------------------------------------------------------------------------

class RetryRounds(StatefulProcessor):
    """Per key: attempts since the last success and when the next one is due; a row per attempt that fell due."""

    def __init__(self, key: str, time: str, rounds: int, base: int, ceiling: int, sleep: int):
        self.key, self.time, self.rounds, self.base, self.ceiling, self.sleep = key, time, rounds, base, ceiling, sleep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tries", T.StructType([T.StructField(n, T.LongType()) for n in ("attempt", "last", "due")]))

    def plan(self, attempt: int) -> tuple[int, int]:
        """(round, delay in seconds) of an attempt."""
        step = (attempt - 1) % self.rounds + 1
        return step, self.sleep if step == self.rounds else min(self.ceiling, self.base * 2 ** step)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, last, due = self.state.get() if self.state.exists() else (0, 0, 0)
        timer = due
        at, ok = _collected(rows, "at_micros", "ok")
        order = np.lexsort((ok, at))
        out = []
        for t, good in zip(at[order].tolist(), ok[order].tolist()):
            if due and due <= t:
                out.append((attempt, last, due))
                due = 0
            if good:
                attempt = last = due = 0
            else:
                attempt, last = attempt + 1, t
                due = t + self.plan(attempt)[1] * SECOND
        if timer != due:
            if timer:
                self.handle.deleteTimer(_timer(timer))
            if due:
                self.handle.registerTimer(_timer(due))
        if attempt:
            self.state.update((attempt, last, due))
        else:
            self.state.clear()
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, last, due = self.state.get() if self.state.exists() else (0, 0, 0)
        if due:
            self.state.update((attempt, last, 0))
            yield self._rows(key, [(attempt, last, due)])

    def _rows(self, key, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        plans = [self.plan(a) for a, _, _ in found]
        return pd.DataFrame({self.key: _objects([key[0]] * len(found)), "attempt": pd.Series([a for a, _, _ in found], dtype="int64"), "last_failure": _stamp([t for _, t, _ in found]),
                             "round": pd.Series([r for r, _ in plans], dtype="int64"), "delay": pd.Series([d for _, d in plans], dtype="int64"), "next_retry_at": _stamp([d for _, _, d in found])})

    def close(self) -> None:
        pass


def retry_rounds(outcomes: DataFrame, *, key: str, time: str, ok: Column, rounds: int = 5, base: int = 5, ceiling: int = 60, sleep: int = 1800, delay: str = "0 seconds") -> DataFrame:
    """Stream of outcomes to one row per attempt that fell due (as ``jobs.due_retries`` has them at that time).

    A failure plans the next attempt, a success clears the key, a row of the key before the attempt is due replaces it. After every
    ``rounds`` attempts the delay is the long ``sleep`` and the rounds begin again. A null ``ok`` is a failure. Failures at the time of a success are before it.
    """
    stamped = outcomes.select(key, F.col(time).cast("timestamp").alias("__at"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_micros"),
                              F.coalesce(ok, F.lit(False)).cast("int").alias("ok")).withWatermark("__at", delay)
    shape = T.StructType([T.StructField(key, outcomes.schema[key].dataType), T.StructField("attempt", T.LongType()), T.StructField("last_failure", T.TimestampType()),
                          T.StructField("round", T.LongType()), T.StructField("delay", T.LongType()), T.StructField("next_retry_at", T.TimestampType())])
    return stamped.groupBy(key).transformWithStateInPandas(
        statefulProcessor=RetryRounds(key, time, rounds, base, ceiling, sleep), outputStructType=shape, outputMode="Append", timeMode="EventTime")
