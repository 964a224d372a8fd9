"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, an exact cut.

Each row gets a random but repeatable key (a hash of id and text), which orders its source. The key space of a source is cut
into equal cells of about ``ROWS_PER_CELL`` rows (as many bits as its row count asks for), word counts are summed per cell and
a running sum over the cells finds the one cell where the budget ends. Only the rows of that cell are sorted; every other row
lies on a known side of the cut. So no source, however hot, is sorted in one task, and texts are not shuffled.

A source whose target is larger than itself is taken in whole epochs first; the cut falls into its last, partial epoch. The
document at the cut gives the words that are left of the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.llm.common import checkpointed, col, others, small_side, unused, word_count

ROWS_PER_CELL = 4096
MOST_SOURCES = 1_000_000  # plan rows on the driver; more raise an error, none are dropped

_PLAN = "m_source string, source_size bigint, target double, m_epochs bigint, m_budget bigint, m_shift int"
_CUTS = "m_source string, source_size bigint, target double, m_epochs bigint, m_key bigint, m_words bigint"


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Words wanted of each source: all sizes shared by weight, at most ``most`` times a source, the excess shared again.

    Weights repeat along the sources in code point order, null last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(names)
    while open_:
        unit = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / unit > most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / unit for s in open_}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def mix_key(key: Column, text: Column, seed: int = 7) -> Column:
    return F.xxhash64(F.lit(seed), key, text)


def _cuts(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row per source: target, whole epochs, the key at the cut and the words its rows still give.

    ``rows`` has columns m_source, m_size and m_key.
    """
    spark = rows.sparkSession
    found = rows.groupBy("m_source").agg(F.sum("m_size").alias("words"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = targets({r["m_source"]: int(r["words"]) for r in found}, weights, most)
    plan = []
    for r in found:
        words, target = int(r["words"]), wanted[r["m_source"]]
        epochs, budget = divmod(round(target), words) if words else (0, 0)
        bits = max(1, (r["rows"] // ROWS_PER_CELL).bit_length())
        plan.append((r["m_source"], words, target, epochs, budget, 64 - bits))
    planned = spark.createDataFrame(plan, _PLAN)
    same = F.col("m_source").eqNullSafe(F.col("p_source"))
    celled = (rows.join(small_side(planned.select(F.col("m_source").alias("p_source"), "m_budget", "m_shift")), same)
              .select("m_source", "m_budget", "m_size", "m_key", F.expr("shiftright(m_key, m_shift)").alias("m_cell")))
    sums = celled.groupBy("m_source", "m_budget", "m_cell").agg(F.sum("m_size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("m_source").orderBy("m_cell").rowsBetween(W.unboundedPreceding, 0))
    ends = (sums.withColumn("upto", upto).where((F.col("upto") > F.col("m_budget")) & (F.col("upto") - F.col("words") <= F.col("m_budget")))
            .select(F.col("m_source").alias("e_source"), F.col("m_cell").alias("e_cell"), (F.col("upto") - F.col("words")).alias("before")))
    inside = celled.join(ends, F.col("m_source").eqNullSafe(F.col("e_source")) & (F.col("m_cell") == F.col("e_cell")))
    # Rows with one key are the same row repeated: they share what is left of the budget.
    units = inside.groupBy("m_source", "m_budget", "before", "m_key").agg(F.sum("m_size").alias("words"), F.count(F.lit(1)).alias("copies"))
    through = F.col("before") + F.sum("words").over(W.partitionBy("m_source").orderBy("m_key").rowsBetween(W.unboundedPreceding, 0))
    cut = (units.withColumn("upto", through).where((F.col("upto") > F.col("m_budget")) & (F.col("upto") - F.col("words") <= F.col("m_budget")))
           .select("m_source", "m_key", F.floor((F.col("m_budget") - F.col("upto") + F.col("words")) / F.col("copies")).alias("m_words"))
           .collect())
    at = {r["m_source"]: (r["m_key"], r["m_words"]) for r in cut}
    # No cut: the budget is used up by whole epochs (0) or reaches the end of the order.
    return spark.createDataFrame([(s, n, t, e, *at.get(s, (None, None))) for s, n, t, e, _, _ in plan], _CUTS)


def mix_sources(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """``df`` with size, source_size, target, taken (words the mix takes, repeats counted), epochs (whole takes) and cut_words.

    ``taken = size * epochs + cut_words``: each source's sum is its rounded target, short of it by less than the number of
    copies where the row at the cut is repeated. Size counts runs of anything but ASCII white space; a null or blank text has
    none and is never cut. A null source is a source, the last in order. Rows with equal id and text share one key. An empty
    table gives an empty result; existing columns of the added names are replaced.
    """
    new = ("size", "source_size", "target", "taken", "epochs", "cut_words")
    text, source = col(text_column), col(source_column).cast("string")
    own = unused(df, "m_source", "m_size", "m_key")
    worked = (source, word_count(text), mix_key(col(id_column), text, seed))
    narrow = checkpointed(df.select(*[w.alias(n) for w, n in zip(worked, ("m_source", "m_size", "m_key"))]))
    keyed = df.select(*others(df, *new), *[w.alias(n) for w, n in zip(worked, own)])
    return _applied(df, keyed, _cuts(narrow, weights, most), new, own)


def _applied(df: DataFrame, keyed: DataFrame, cuts: DataFrame, new: Sequence[str], own: Sequence[str]) -> DataFrame:
    """``keyed`` (``df`` and the working columns ``own``) with what its source's cut gives each row."""
    names = unused(df, "c_source", "c_key", "c_epochs", "c_words")
    c_source, c_key, c_epochs, c_words = map(F.col, names)
    m_source, m_size, m_key = map(F.col, own)
    renamed = cuts.select(*[F.col(c).alias(n) for c, n in zip(("m_source", "m_key", "m_epochs", "m_words"), names)], "source_size", "target")
    joined = keyed.join(small_side(renamed), m_source.eqNullSafe(c_source), "left")
    before, here = F.coalesce(m_key < c_key, F.lit(False)), F.coalesce(m_key == c_key, F.lit(False))
    epochs = c_epochs + before.cast("int")
    words = F.when(here, F.least(c_words, m_size)).otherwise(F.lit(0)).cast("bigint")
    return joined.select(*others(df, *new), m_size.alias("size"), "source_size", "target",
                         (m_size * epochs + words).alias("taken"), epochs.alias("epochs"), words.alias("cut_words"))
