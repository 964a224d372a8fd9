"""Position of a key among sorted cut points, as one Catalyst expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_longs(values: Sequence[int]) -> Column:
    """One constant ``array<bigint>``: a single literal after constant folding, however many values it holds."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def count_not_above(table: Column | Sequence[int], size_or_key, key: Column | None = None) -> Column:
    """How many of the ascending cut points are ``<= key``: a binary search, about log2(cut points) steps a row.

    ``count_not_above(cuts, key)`` for a list of longs, ``count_not_above(table, size, key)`` for a constant array of any type.
    """
    if key is None:
        cuts, key = table, size_or_key
        table, size = constant_longs(cuts), len(cuts)
    else:
        size = size_or_key
    if not size:
        return F.lit(0)
    steps = [1 << b for b in range(size.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda found, step: F.when((found + step <= size) & (F.get(table, found + step - 1) <= key), found + step).otherwise(found))
