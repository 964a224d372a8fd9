"""G: order, keep-first de-duplication, top-k, batches and paging.

``row_number() <= k`` filters are planned with a partial group limit before the shuffle, so a hot
key sends at most ``k`` rows per map task. Full rankings go through ``running``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.functions import text
from serialake.operators.running import position, running_sums


def keep_first(df: DataFrame, *, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """G1: the first row of each key in encounter order."""
    return keep_top(df, key=key, order=order, k=1)


def keep_top(df: DataFrame, *, key: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def keep_largest(df: DataFrame, *, key: Sequence[str], size: Column, name: str, requested: Column | None = None) -> DataFrame:
    """Per key keep the largest content (ties: smallest name) and give it the requested name."""
    best = keep_first(df, key=key, order=[size.desc(), F.col(name)])
    return best if requested is None else best.withColumn(name, requested)


def _fresh_walk(items: DataFrame, group: str, page: str, pos: str, url: str) -> tuple[DataFrame, DataFrame]:
    """(first occurrence of every url, last page of the unbroken run 1..p that each brought a new url)."""
    first = keep_first(items, key=[group, url], order=[page, pos])
    fresh = first.select(group, F.col(page).cast("bigint").alias("__page")).distinct()
    # The run ends before the first page that follows a filled one (or page 1) without being filled itself.
    following = fresh.select(group, F.col("__page") + 1).union(fresh.select(group).distinct().select(group, F.lit(1).cast("bigint"))).toDF(group, "__page")
    last = following.join(fresh, [group, "__page"], "left_anti").groupBy(group).agg((F.min("__page") - 1).alias("__last")).where("__last > 0")
    return first, last


def until_saturated(items: DataFrame, *, group: str, page: str, pos: str, url: str, limit: int | None = None) -> DataFrame:
    """Unique items of a paged list, up to the page before the first one that adds no new url.

    A url is new on its first page, so the walk needs no loop. A list without page 1 is empty.
    """
    first, last = _fresh_walk(items, group, page, pos, url)
    kept = first.join(last, group).where(F.col(page) <= F.col("__last")).drop("__last")
    return kept if limit is None else kept.where(F.col(page) <= limit)


def pages_walked(items: DataFrame, *, group: str, page: str, pos: str, url: str, announced: DataFrame | None = None,
                 total: str = "total_pages", max_pages: int | None = None) -> DataFrame:
    """Per group the useful pages, the pages read and the total to report.

    The page that stops the walk is read as well, unless ``max_pages``, where given, ends the walk first. The
    useful pages are those that ``until_saturated`` returns under the same limit.
    """
    _, last = _fresh_walk(items, group, page, pos, url)
    if announced is not None:
        last = last.join(announced.select(group, F.col(total).cast("bigint").alias("__total")), group, "left")
    else:
        last = last.withColumn("__total", F.lit(0).cast("bigint"))
    announced_total = F.coalesce("__total", F.lit(0).cast("bigint"))
    window = F.lit(max_pages).cast("bigint")  # least() ignores a null window
    useful = F.least("__last", window)
    return last.select(group, useful.alias("useful_pages"), F.least(F.col("__last") + 1, window).alias("pages_read"),
                       F.greatest(announced_total, useful).alias("total_pages"))


def until_short_page(pages: DataFrame, *, group: str, page: str, new_items: str, page_size: int, expected: Column | None = None) -> DataFrame:
    """Pages of a list up to and including the first short one, or the one that reaches ``expected`` items.

    A page without new items ends the list and is not part of it.
    """
    progress = running_sums(pages, key=[group], order=[page], measures={"seen": F.col(new_items)})
    stops = F.col(new_items) < page_size
    if expected is not None:
        stops = stops | (F.coalesce(expected, F.lit(0)) > 0) & (F.col("seen") >= expected)
    first_stop = progress.where(stops).groupBy(group).agg(F.min(page).alias("__stop"))
    joined = progress.join(first_stop, group, "left")
    return joined.where((F.col("__stop").isNull() | (F.col(page) <= F.col("__stop"))) & (F.col(new_items) > 0)).drop("__stop")


def even_batches(df: DataFrame, *, batches: int, order: Sequence[str], key: Sequence[str] = (), name: str = "batch") -> DataFrame:
    """``batches`` consecutive groups whose sizes differ by at most one, larger ones first (``ntile``)."""
    placed = position(df, key=key, order=order, name="__p")
    if key:
        totals = df.groupBy(*key).agg(F.count("*").alias("__n"))
        placed = placed.join(totals, list(key))
    else:
        placed = placed.withColumn("__n", F.lit(df.count()))  # one number
    small, extra = F.floor(F.col("__n") / batches), F.col("__n") % batches
    boundary = extra * (small + 1)
    number = F.when(F.col("__p") < boundary, F.floor(F.col("__p") / (small + 1)))\
              .otherwise(extra + F.floor((F.col("__p") - boundary) / F.greatest(small, F.lit(1))))
    return placed.select(*df.columns, (number + 1).cast("bigint").alias(name))


def fixed_batches(df: DataFrame, *, size: int, order: Sequence[str], key: Sequence[str] = (), name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows."""
    placed = position(df, key=key, order=order, name="__p")
    return placed.select(*df.columns, (F.floor(F.col("__p") / size) + 1).cast("bigint").alias(name))


def request_ranges(df: DataFrame, *, total: str, size: int = 100) -> DataFrame:
    """Consecutive (from, to) ranges of ``size`` up to ``total``; a row without a positive total stays, with null bounds."""
    last = F.when(F.col(total) > 0, F.col(total).cast("bigint"))
    out = df.withColumn("from", F.explode_outer(F.sequence(F.lit(1).cast("bigint"), last, F.lit(size).cast("bigint"))))
    return out.withColumn("to", F.when(F.col("from").isNotNull(), F.least(F.col("from") + (size - 1), last)))


def longest(df: DataFrame, *, size: str, tie: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` largest rows, ties in encounter order."""
    return df.orderBy(F.col(size).desc(), *tie).limit(n)


def number_parts(df: DataFrame, *, key: Sequence[str], number: Column, pos: str, name: str = "place") -> DataFrame:
    """Place of each part in its work by number (missing number counts as 0), then list position."""
    keyed = df.withColumn("__number", F.coalesce(number, F.lit(0)).cast("bigint"))
    return position(keyed, key=key, order=["__number", pos], name=name).drop("__number")


def last_lines(lines: DataFrame, *, file: str, modified: str, line_no: str, n: int = 20) -> DataFrame:
    """Last ``n`` lines of the most recently modified file."""
    newest = lines.select(F.max(F.struct(modified, file)).alias("f")).select(F.col("f").getField(file).alias(file))
    return lines.join(newest, file, "left_semi").orderBy(F.col(line_no).desc()).limit(n)


def canonical_index(parts: DataFrame, *, title: str = "title", url: str = "url", pos: str = "pos", keep: Sequence[str] = ()) -> DataFrame:
    """Export index: number from the title, else position + 1 (a number 0 counts as absent), with its file name."""
    number = F.coalesce(F.nullif(text.part_number(title), F.lit(0)), F.col(pos).cast("bigint") + 1)
    indexed = parts.select(*keep, number.alias("index"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url"))
    return indexed.withColumn("file", text.part_file_name("title", "index"))
