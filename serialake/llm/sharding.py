"""Sharding by histogram sort: exact byte counts below candidate keys, refined until splitters meet a tolerance, one exchange.

The sort key of a row is a bigint: 32 bits of the text's hash, then 32 bits of the id's hash. Equal texts are neighbours in
that order, rows of one hot text still spread over 2^32 keys. Every splitter keeps an interval of keys that must hold it; one
round counts bytes and rows below all probes of all intervals in one aggregation (one row per probe reaches the driver,
whatever the input size) and each interval shrinks to the gap between two probes. Probes stand at text boundaries as long as
an interval spans several texts, so a group of equal texts is cut only if no boundary beside it meets the tolerance.

The splitters cut finer ranges than shards (a multiple of the shuffle partitions), so numbering the rows of a shard is a
window over a range, never over a whole shard, and counts below the range's splitter give the offset.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.functions.search import constant_longs, count_not_above
from serialake.llm.common import checkpointed, col, others, unused

LOWEST, HIGHEST, GROUP = -(1 << 63), (1 << 63) - 1, 1 << 32


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def sort_key(text: Column, key: Column) -> Column:
    return F.shiftleft(F.xxhash64(text), 32).bitwiseOR(F.xxhash64(key).bitwiseAND(F.lit(GROUP - 1)))


def _probes(low: int, high: int, count: int) -> set[int]:
    """About ``count`` boundaries b with low < b <= high; at text boundaries while the interval holds several texts."""
    if high // GROUP > low // GROUP:
        first, last = low // GROUP + 1, high // GROUP
        step = max(1, -(-(last - first + 1) // count))
        return {g * GROUP for g in range(first, last + 1, step)} | {last * GROUP}
    step = max(1, -(-(high - low) // count))
    return set(range(low + 1, high + 1, step)) | {high}


def splitters(keys: DataFrame, targets: list[tuple[float, float]], probes: int = 8192) -> list[tuple[int, int, int]]:
    """(boundary, bytes below, rows below) for each (target bytes, tolerance); ``keys`` has columns ``key`` and ``size``.

    The error of a splitter is at most its tolerance, or half of the rows of one key where a single key is larger than that.
    """
    whole = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if not whole[1]:
        return [(HIGHEST, 0, 0)] * len(targets)
    ends = [(whole[2], 0, 0), (whole[3] + 1, int(whole[0]), whole[1])]  # boundaries known to stand on either side
    open_ = {i: (ends[0], ends[1], whole[2], whole[3]) for i in range(len(targets))}
    found: dict[int, tuple[int, int, int]] = {}
    while open_:
        intervals = {(low, high) for _, _, low, high in open_.values()}
        per = max(8, probes // len(intervals))
        bounds = {b[0] for left, right, _, _ in open_.values() for b in (left, right) if b[0] <= HIGHEST}
        cuts = sorted(bounds.union(*[_probes(low, high, per) for low, high in intervals]))
        rows = (keys.groupBy(count_not_above(cuts, F.col("key")).alias("bin"))
                .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
                .collect())
        bins = {r["bin"]: r for r in rows}
        bytes_ = list(accumulate((int(bins[b]["bytes"]) if b in bins else 0) for b in range(len(cuts))))  # below cuts[b]
        count = list(accumulate((bins[b]["rows"] if b in bins else 0) for b in range(len(cuts))))
        for i, (left, right, _, _) in list(open_.items()):
            target, tolerance = targets[i]
            at = bisect_left(bytes_, target)  # the first cut with at least the target below it
            if at > 0 and cuts[at - 1] > left[0]:
                left = (cuts[at - 1], bytes_[at - 1], count[at - 1])
            if at < len(cuts) and cuts[at] < right[0]:
                right = (cuts[at], bytes_[at], count[at])
            best = min(left, right, key=lambda b: (abs(b[1] - target), b))
            inside = bins.get(at)
            if abs(best[1] - target) <= tolerance or inside is None or inside["low"] >= inside["high"]:
                found[i] = best
                del open_[i]
            else:
                open_[i] = (left, right, inside["low"], inside["high"])
    return [found[i] for i in range(len(targets))]


def shard_by_bytes(df: DataFrame, *, shards: int, id_column: str = "doc_id", text_column: str = "text", overhead: int = 8,
                   tolerance: float = 0.005, ranges: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 … shards-1, near equal in bytes) and ``slot`` (gapless from 0 within the shard).

    A row weighs its text's UTF-8 bytes plus ``overhead`` (null text: the overhead alone). A shard's ends are off by at most
    ``tolerance`` of a shard, or by half a row (rows with equal text and equal id count as one: they stay together). Equal texts
    stay in one shard unless that breaks the tolerance. Null ids hash like a value of their own. An empty table gives an empty
    result. Existing columns named shard or slot are replaced, all others are kept. No row is dropped.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = max(1, -(-(ranges or 2 * partitions) // shards))
    size, key = text_bytes(col(text_column)) + F.lit(overhead), sort_key(col(text_column), col(id_column))
    keys = checkpointed(df.select(key.alias("key"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    edges = shards * per_shard
    targets = [(total * i / edges, total * (tolerance / shards if i % per_shard == 0 else 0.25 / edges)) for i in range(1, edges)]
    cuts = splitters(keys, targets)
    ends = {0: (LOWEST, 0, 0), shards: (HIGHEST, 0, 0)} | {i // per_shard: cuts[i - 1] for i in range(per_shard, edges, per_shard)}
    for s in range(1, shards):  # in order, also where a hot key holds several splitters
        ends[s] = max(ends[s], ends[s - 1])
    ordered = []
    for i in range(1, edges):
        s = i // per_shard
        here = ends[s] if i % per_shard == 0 else min(max(cuts[i - 1], ends[s]), ends[s + 1])
        ordered.append(max(here, ordered[-1]) if ordered else here)
    below = [0] + [c[2] for c in ordered]
    offsets = [below[r] - below[r - r % per_shard] for r in range(edges)]
    own_key, own_range, own_id = unused(df, "own_key", "own_range", "own_id")
    keyed = df.select(*others(df, "shard", "slot"), key.alias(own_key), col(id_column).alias(own_id))
    ranged = keyed.withColumn(own_range, count_not_above([c[0] for c in ordered], F.col(own_key)))
    place = F.row_number().over(W.partitionBy(own_range).orderBy(own_key, own_id))
    return ranged.select(
        *others(df, "shard", "slot"),
        F.floor(F.col(own_range) / per_shard).cast("int").alias("shard"),
        (F.get(constant_longs(offsets), F.col(own_range)) + place - 1).cast("bigint").alias("slot"))
