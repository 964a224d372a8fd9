"""Order-dependent computations that never put an unbounded group into one task.

A window over one hot key, or over no key at all, is a single sort in a single task. These
operators cut the order into ranges first: each range is summarised by an ordinary aggregation,
the summaries (at most one row per key and range) get their prefix values, and the rows only ever
see a window of one range. Results are exact; only the cut points come from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from serialake.functions.search import count_not_above

SAMPLE_PER_RANGE = 16
HASH_PLACES = 1 << 40
ONE_IN = 64  # share of the hashes that can become sample rows; a table too small for that needs no ranges


def _constant(value, kind: T.DataType) -> str:
    """SQL of one value of a cut point; text goes as hexadecimal digits, so nothing has to be quoted."""
    if value is None:
        inner = "null"
    elif isinstance(kind, T.StringType):
        inner = f"x'{value.encode().hex()}'"
    elif isinstance(kind, T.BinaryType):
        inner = f"x'{bytes(value).hex()}'"
    else:
        inner = f"'{value}'"
    return f"cast({inner} as {kind.simpleString()})"


def constant_structs(rows: Sequence, schema: T.StructType) -> Column:
    """One constant ``array<struct>``: a single literal after constant folding, built in one call."""
    def one(row) -> str:
        return "named_struct(" + ", ".join(f"'{f.name}', {_constant(v, f.dataType)}" for v, f in zip(row, schema.fields)) + ")"
    return F.expr("array(" + ", ".join(map(one, rows)) + ")")


def range_of(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> Column:
    """Range number of a row along ``order`` (ascending, nulls first).

    Cut points are quantiles of a repeatable sample, so the same table is always cut the same way and a hot key is cut inside the key, by
    the columns that follow it. The sample is one aggregation: a fixed share of the hashes of the order columns is dealt to ``16 * ranges``
    places, and each place keeps its smallest; tasks hand on one row a place at most. A row finds its range by binary search among the constant cut points.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tuple_ = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(order)])
    place = F.pmod(F.xxhash64("t"), F.lit(HASH_PLACES))
    hashed = df.select(tuple_.alias("t")).select("t", place.alias("h")).where(F.col("h") % ONE_IN == 0)
    smallest = hashed.groupBy(F.floor(F.col("h") / -(-HASH_PLACES // (ranges * SAMPLE_PER_RANGE))).alias("place")).agg(F.min(F.struct("h", "t")).alias("m"))
    sampled = smallest.select("m.t").orderBy("t").select("t.*")
    rows = sampled.collect()
    step = max(1, len(rows) // ranges)
    cuts = rows[step::step]
    return count_not_above(constant_structs(cuts, sampled.schema), len(cuts), tuple_) if cuts else F.lit(0)


def _same_range(key: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*key, "__range")]


def _renamed(df: DataFrame, key: Sequence[str], *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__k_{c}") for c in (*key, "__range")], *columns)


def running_sums(df: DataFrame, *, key: Sequence[str], order: Sequence[str], measures: dict[str, Column],
                 ranges: int | None = None) -> DataFrame:
    """Add inclusive running sums of integer ``measures`` per key, along ``order`` (a total order within the key)."""
    key, order = list(key), list(order)
    cut = df.withColumn("__range", range_of(df, [*key, *order], ranges))
    for name, value in measures.items():
        cut = cut.withColumn(f"__m_{name}", F.coalesce(value.cast("bigint"), F.lit(0)))
    totals = cut.groupBy(*key, "__range").agg(*[F.sum(f"__m_{n}").alias(f"__s_{n}") for n in measures])
    earlier = W.partitionBy(*key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*key, "__range", *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in measures])
    inside = W.partitionBy(*key, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.select("*", *[F.sum(f"__m_{n}").over(inside).alias(f"__r_{n}") for n in measures])
    joined = rows.join(_renamed(offsets, key, *[f"__o_{n}" for n in measures]), _same_range(key))
    return joined.select(*df.columns, *[(F.col(f"__o_{n}") + F.col(f"__r_{n}")).alias(n) for n in measures])


def previous_value(df: DataFrame, *, key: Sequence[str], order: Sequence[str], value: Column, name: str,
                   ranges: int | None = None) -> DataFrame:
    """Add the previous row's ``value`` per key (``lag``), null for the first row."""
    key, order = list(key), list(order)
    cut = df.withColumn("__range", range_of(df, [*key, *order], ranges)).withColumn("__v", F.struct(value.alias("v")))
    last = cut.groupBy(*key, "__range").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carry", F.lag("__last").over(W.partitionBy(*key).orderBy("__range")))
    rows = cut.withColumn("__lag", F.lag("__v").over(W.partitionBy(*key, "__range").orderBy(*order)))
    joined = rows.join(_renamed(carried, key, "__carry"), _same_range(key))
    return joined.select(*df.columns, F.coalesce("__lag", "__carry").getField("v").alias(name))


def position(df: DataFrame, *, key: Sequence[str] = (), order: Sequence[str], name: str = "position", start: int = 0,
             ranges: int | None = None) -> DataFrame:
    """Dense position per key (``row_number``) along a total order, safe for one hot key or no key."""
    counted = running_sums(df, key=key, order=order, measures={"__n": F.lit(1)}, ranges=ranges)
    return counted.select(*df.columns, (F.col("__n") + F.lit(start - 1)).alias(name))
