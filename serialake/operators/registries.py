"""H and the exclusion joins E4, E5, E15: sets, registries and what is already known.

Exclusions are anti-joins without hints: Spark broadcasts a registry that is small by its own
statistics and shuffles it when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.operators.ordering import keep_first


def without_skipped(works: DataFrame, skipped: DataFrame, *, slug: str) -> DataFrame:
    """Works whose slug is not on the skip list."""
    return works.join(skipped.select(slug), slug, "left_anti")


def mark_completed(works: DataFrame, completed: DataFrame, *, key: str) -> DataFrame:
    """E5: completed works stay (their metadata is refreshed) but are not collected again."""
    done = completed.select(key).distinct().withColumn("completed", F.lit(True))
    marked = works.join(done, key, "left").withColumn("completed", F.coalesce("completed", F.lit(False)))
    return marked.withColumn("collect", ~F.col("completed"))


def without_seen(rows: DataFrame, seen: DataFrame, *, key: str) -> DataFrame:
    """Rows whose key was not processed before."""
    return rows.join(seen.select(key), key, "left_anti")


def merge_completed(states: Sequence[DataFrame], *, key: str) -> DataFrame:
    """H1: union of the completed sets of several workers (order it where it is written)."""
    merged = states[0].select(key)
    for state in states[1:]:
        merged = merged.union(state.select(key))
    return merged.where(F.col(key).isNotNull()).distinct()


def difference(expected: DataFrame, actual: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """H2/H4: rows of ``expected`` without a counterpart in ``actual``."""
    return expected.join(actual.select(*on), list(on), "left_anti")


def append_unseen(registry: DataFrame, new: DataFrame, *, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """H3: registry plus the first new row of every key it does not hold yet."""
    fresh = keep_first(new.join(registry.select(*key), list(key), "left_anti"), key=key, order=order)
    return registry.unionByName(fresh)


def append_all(registry: DataFrame, new: DataFrame) -> DataFrame:
    """H3: an error log keeps every row."""
    return registry.unionByName(new)
