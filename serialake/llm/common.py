"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.materialise import checkpointed

__all__ = ["checkpointed", "col", "others", "small_side", "table", "unused", "word_count", "slices"]

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *new: str) -> list[Column]:
    """The columns of ``df`` that do not clash (Spark ignores case) with columns an operator adds: the operator's win."""
    taken = {n.lower() for n in new}
    return [col(c) for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it (Spark ignores case): for working columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` (a few narrow columns) for the small side of a join: broadcast if counted to at most ``most_rows``, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def word_count(text: Column) -> Column:
    """Number of words of a text as bigint; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(batches: Iterator, column: str, most: int = 8_000_000) -> Iterator:
    """Arrow batches cut into pieces of about ``most`` bytes of ``column``; a longer single text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // batch.num_rows)
        step = max(1, most // per_row)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
