"""E: reconciliation of what a source lists with what is stored.

Tables: ``canonical`` and ``listed`` have (work, pos, index, title, url, file), ``saved`` has
(work, file, size), ``dead`` has (work, index, url). Joins are keyed by (work, number), (work, url)
or (work, file), so the parts of one very large work spread over all partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.functions import text
from serialake.materialise import checkpointed
from serialake.operators.ordering import keep_first, keep_top

LARGEST = 10**14  # part numbers beyond it (either sign) are read as none where offsets are counted
BLOCK = 1 << 16  # offsets summed up in one window
SALTS = 8  # pieces that the parts of one work are dealt to when they meet the work's row


def part_number(*, index: str = "index", title: str = "title", pos: str = "pos") -> Column:
    """Stored index, else number in the title, else list position + 1."""
    return F.coalesce(F.col(index).cast("bigint"), text.part_number(title), F.col(pos).cast("bigint") + 1)


def saved_number(file: str = "file") -> Column:
    """Number of a stored part: any leading digits of its file name."""
    return F.regexp_extract(file, r"^([0-9]+)", 1).try_cast("bigint")


def _name(column: str) -> str:
    """A column's name inside SQL."""
    return "`" + column.replace("`", "``") + "`"


def _keyed(parts: DataFrame, work: str) -> DataFrame:
    # The key is one projected expression, so its repeated parts are evaluated once; a filter on it alone would be pushed below and
    # evaluate it a second time, a filter on the generated column is not.
    keys = parts.select(work, text.match_key(F.coalesce("title", F.lit(""))).alias("__made"), part_number().alias("__num"))
    keyed = keys.select(work, "__num", F.explode(F.array("__made")).alias("__key")).where("__key <> ''")
    return keyed.where(F.col("__num").between(-LARGEST, LARGEST))


def _steps(numbers: DataFrame, work: str, *, distinct: bool) -> DataFrame:
    """Run-length form of the numbers of each (work, key): where their count steps up or down (``__d``), seen from left to right.

    n consecutive numbers become two rows. One more row of a key, without a place, holds its number of rows. With ``distinct`` a number
    counts once (and so does that row).
    """
    ends = numbers.selectExpr(_name(work), "__key", """inline(array(named_struct('__at', __num, 'here', 1, 'before', 0), named_struct('__at', __num + 1, 'here', 0, 'before', 1),
        named_struct('__at', cast(null as bigint), 'here', 1, 'before', 0)))""")
    fold = "max" if distinct else "sum"
    stepped = ends.groupBy(work, "__key", "__at").agg(F.expr(f"cast({fold}(here) - {fold}(before) as bigint) as __d"))
    return stepped.where("__at is null or __d <> 0")


def _second_differences(canonical: DataFrame, listed: DataFrame, work: str) -> DataFrame:
    """Per work and offset the second difference ``e`` of the number of pairs with equal titles; without offset, the matched rows.

    The number of pairs at an offset is a cross-correlation of two step functions. Its second difference lives on pairs of steps, so a
    title repeated through n consecutive parts costs as much as one that occurs once. The table is read three times: one exchange
    serves them all.
    """
    left = _steps(_keyed(canonical, work), work, distinct=True)
    right = _steps(_keyed(listed, work), work, distinct=False).selectExpr(f"{_name(work)} as __lwork", "__key as __lkey", "__at as __lat", "__d as __ld")
    pairs = left.join(right, F.expr(f"{_name(work)} = __lwork and __key = __lkey and isnull(__at) = isnull(__lat)"), "left").where("__at is null or __lat is not null")
    placed = pairs.selectExpr(_name(work), "__at - __lat as __offset", "__d * __ld as e").selectExpr("*", f"floor((__offset + {BLOCK // 2}) / {BLOCK}) as __block")
    summed = placed.groupBy(work, "__block", "__offset").agg(F.expr("coalesce(sum(e), 0) as e"))
    return summed.where("__offset is null or e <> 0").repartition(work, "__block")


def _pieces(steps: DataFrame, work: str) -> DataFrame:
    """The numbers of pairs as straight pieces: at ``__offset + j`` there are ``n + j * slope`` pairs, for j < ``span``.

    Sums run within blocks of offsets; what lies before a block enters it as one row, so no task needs all offsets of a work.
    """
    key = _name(work)
    own = steps.where("__offset is not null").selectExpr(key, "__block", "__offset", "e", "cast(__offset as decimal(16,0)) * e as m", "cast(null as bigint) as beyond")
    blocks = own.groupBy(work, "__block").agg(F.expr("sum(e) as e"), F.expr("sum(m) as m"), F.expr("min(__offset) as first"))
    earlier = f"over (partition by {key} order by __block rows between unbounded preceding and 1 preceding)"
    entry = blocks.selectExpr(key, "__block", "cast(null as bigint) as __offset", f"coalesce(sum(e) {earlier}, 0) as e", f"coalesce(sum(m) {earlier}, 0) as m",
                              f"lead(first) over (partition by {key} order by __block) as beyond")
    inside = f"partition by {key}, __block order by __offset nulls first"
    before = f"over ({inside} rows between unbounded preceding and 1 preceding)"
    summed = own.unionByName(entry).selectExpr(
        key, "__offset", f"cast(sum(m) {before} - __offset * sum(e) {before} as bigint) as n", f"-sum(e) over ({inside} rows between unbounded preceding and current row) as slope",
        f"coalesce(lead(__offset) over ({inside}), max(beyond) over (partition by {key}, __block)) - __offset as span")
    return summed.where("__offset is not null and span > 0 and (n > 0 or slope > 0)")


def numbering_offsets(canonical: DataFrame, listed: DataFrame, saved: DataFrame, *, work: str = "work") -> DataFrame:
    """Per work the most frequent (canonical - listed) number difference over equal titles, and whether to skip the source.

    Confident when the best offset has 3 matches or 60 %, or at most 2 rows matched; a non-zero best
    with a runner-up at most one behind is not. An unsure or unmatched source is skipped when
    numbered parts are already saved. Ties go to the smallest absolute offset, then the smaller one.
    """
    steps = _second_differences(canonical, listed, work)
    # The two best offsets of a straight piece lie at its ends or, where it is level, nearest to zero.
    key, zero = _name(work), F.lit(0).cast("bigint")
    levelled = _pieces(steps, work).selectExpr("*", "greatest(0L, least(span - 1, -__offset)) as level")
    counts = levelled.selectExpr(key, "__offset", "n", "slope", "explode(filter(array_distinct(array(0L, 1L, span - 2, span - 1, level - 1, level, level + 1)), j -> j >= 0 and j < span)) as j") \
        .selectExpr(key, "__offset + j as __offset", "n + j * slope as __n").where("__n > 0")
    top = keep_top(counts, key=[work], order=[F.expr("-__n"), F.expr("abs(__offset)"), F.col("__offset")], k=2)
    ranked = top.selectExpr(key, "named_struct('n', -__n, 'a', abs(__offset), 'o', __offset) as r").groupBy(work).agg(F.expr("min(r) as b"), F.expr("max(r) as s"))
    best = ranked.selectExpr(key, "b.o as offset", "-b.n as best", "if(s.o <> b.o, -s.n, 0) as second")
    # Half the second moment of the second differences is the sum of the counts, with the sign turned.
    square = "cast(cast(__offset as decimal(16,0)) * cast(__offset as decimal(16,0)) * e as decimal(38,0)) as square"
    per_work = steps.selectExpr(key, "if(__offset is null, e, null) as rows", square, "false as saved") \
        .unionByName(saved.where(saved_number().isNotNull()).selectExpr(key, "cast(null as bigint) as rows", "cast(null as decimal(38,0)) as square", "true as saved")) \
        .groupBy(work).agg(F.expr("sum(rows) as match_count"), F.expr("cast(coalesce(sum(square), 0) / -2 as bigint) as total"), F.expr("max(saved) as anything"))
    joined = per_work.where("match_count is not null").join(best, work, "left")
    confident = ((F.col("best") >= 3) | (F.col("best") / F.col("total") >= 0.6) | (F.col("match_count") <= 2)) \
        & ~((F.col("offset") != 0) & (F.col("second") > 0) & (F.col("best") - F.col("second") <= 1))
    return joined.select(
        work, F.coalesce("offset", zero).alias("offset"), F.coalesce("best", zero).alias("best"), F.coalesce("second", zero).cast("bigint").alias("second"),
        "total", "match_count", (F.col("anything") & ~F.coalesce((F.col("total") > 0) & confident, F.lit(False))).alias("skip"))


def _with_shift(parts: DataFrame, offsets: DataFrame, work: str) -> DataFrame:
    """Parts with the offset of their work, null for none: few works have one, and a large one is dealt to SALTS pieces."""
    dealt = parts.withColumn("__salt", F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int"))
    spread = offsets.where("offset <> 0").select(work, F.col("offset").alias("__shift"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return dealt.join(spread, [work, "__salt"], "left").drop("__salt")


def _aligned(shift: Column) -> Column:
    """Part number plus the offset, at least 1; a sum that no bigint holds stays at the largest one."""
    number = part_number()
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.try_add(number, F.coalesce(shift, F.lit(0).cast("bigint"))), F.when(number > 0, F.lit(2**63 - 1)).otherwise(F.lit(1))))


def align_listed(listed: DataFrame, offsets: DataFrame, *, work: str = "work") -> DataFrame:
    """Listed parts with their number shifted by the work's offset, never below 1."""
    return _with_shift(listed, offsets, work).withColumn("aligned", _aligned(F.col("__shift"))).drop("__shift")


def first_aligned(aligned: DataFrame, *, work: str = "work") -> DataFrame:
    """The first listed part of every aligned number."""
    return keep_first(aligned, key=[work, "aligned"], order=["pos"])


def missing_parts(canonical: DataFrame, listed: DataFrame, saved: DataFrame, dead: DataFrame, *, work: str = "work",
                  offsets: DataFrame | None = None) -> DataFrame:
    """Canonical parts that are not stored, not dead and still offered by the source.

    Facts about a number (saved, dead, offered, found under its file name) share one table, as do
    facts about a url, so a canonical row meets two joins in all.
    """
    # One row per work, needed twice (skipped works, aligned numbers): computed once and stored.
    offsets = checkpointed(numbering_offsets(canonical, listed, saved, work=work)) if offsets is None else offsets
    skipped = offsets.where("skip").select(work)
    base = canonical.join(skipped, work, "left_anti").withColumn("__num", F.greatest(F.lit(1).cast("bigint"), part_number()))
    # A stored non-empty file under the expected name ends the search for its number, for this row and all after it. The default
    # name begins with the number, which saved numbers cover; only a given name with other digits needs a look at the files.
    files = saved.where(F.col("size") > 0).select(work, "file").distinct()
    other = F.coalesce(saved_number() != F.col("__num"), F.col("file").isNotNull())
    hits = base.where(other).select(work, "file", "__num", "pos").join(files, [work, "file"], "left_semi")
    yes, no, never = F.lit(True), F.lit(False), F.lit(None).cast("bigint")

    def facts(df: DataFrame, key: Column, name: str, s: Column, d: Column, o: Column, hit: Column = never) -> DataFrame:
        return df.select(work, key.alias(name), s.alias("s"), d.alias("d"), o.alias("o"), hit.cast("bigint").alias("h"))

    def gathered(parts: list[DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).where(F.col(name).isNotNull()).groupBy(work, name).agg(
            F.max("s").alias(f"{name}_saved"), F.max("d").alias(f"{name}_dead"), F.max("o").alias(f"{name}_offered"), F.min("h").alias(f"{name}_hit"))

    by_number = gathered([facts(saved, saved_number(), "__num", yes, no, no),
                          facts(dead, F.col("index").cast("bigint"), "__num", no, yes, no),
                          facts(align_listed(listed, offsets, work=work), F.col("aligned"), "__num", no, no, yes),
                          facts(hits, F.col("__num"), "__num", no, no, no, F.col("pos"))], "__num")
    by_url = gathered([facts(dead, F.nullif("url", F.lit("")), "__url", no, yes, no),
                       facts(listed, F.nullif("url", F.lit("")), "__url", no, no, yes)], "__url")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), no)

    open_rows = base.join(by_number, [work, "__num"], "left").where(
        ~flag("__num_saved") & ~flag("__num_dead") & (F.col("__num_hit").isNull() | (F.col("pos") < F.col("__num_hit"))))
    judged = open_rows.withColumn("__url", F.nullif("url", F.lit(""))).join(by_url, [work, "__url"], "left")
    wanted = judged.where(~flag("__url_dead") & (flag("__url_offered") | flag("__num_offered")))
    file = F.coalesce("file", text.part_file_name(F.coalesce("title", F.lit("")), "__num"))
    return wanted.select(work, F.col("pos").alias("idx"), F.col("__num").alias("index"), "title", "url", file.alias("file"))


def misnamed_files(expected: DataFrame, files: DataFrame, *, work: str = "work", number: str = "index", name: str = "file") -> DataFrame:
    """(old, new) where the expected name is absent but a file with the same four-digit prefix exists."""
    absent = expected.select(work, number, name).join(files.select(work, name), [work, name], "left_anti")
    by_prefix = files.groupBy(work, F.regexp_extract(name, r"^([0-9]{4,})_", 1).alias("__prefix")).agg(F.min(name).alias("old_file"))
    prefix = F.format_string("%04d", F.col(number).cast("bigint"))
    return absent.withColumn("__prefix", prefix).join(by_prefix, [work, "__prefix"]).select(work, number, "old_file", F.col(name).alias("new_file"))


def expected_files(works: DataFrame, titles: DataFrame, *, work: str, total: str, pos: str = "pos", title: str = "title") -> DataFrame:
    """Expected file names by position; a position without a title is ``untitled``."""
    slots = works.where(F.col(total) > 0).select(work, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(total).cast("bigint") - 1)).alias("__pos"))
    named = titles.select(work, F.col(pos).cast("bigint").alias("__pos"), title)
    name = F.coalesce(F.col(title), F.lit("untitled"))
    file = F.concat(F.format_string("%04d_", F.col("__pos") + 1), F.trim(text.safe_file_name(name)), F.lit(".txt"))
    return slots.join(named, [work, "__pos"], "left").select(work, F.col("__pos").alias("pos"), file.alias("file"))


def absent_files(expected: DataFrame, actual: DataFrame, *, work: str) -> DataFrame:
    """Expected minus actual."""
    return expected.join(actual.select(work, "file"), [work, "file"], "left_anti")


def canonical_source(source_parts: DataFrame, *, work: str, source: str, order: str) -> DataFrame:
    """Per work the first source in order that lists anything, with its count as the total.

    ``source_parts`` has one row per listed part; counts are partial before the shuffle.
    """
    counts = source_parts.groupBy(work, source).agg(F.min(order).alias("__order"), F.count("*").alias("total_parts"))
    best = counts.groupBy(work).agg(F.min(F.struct("__order", source, "total_parts")).alias("b"))
    return best.select(work, F.col(f"b.{source}").alias(source), F.col("b.total_parts").alias("total_parts"))


def fill_from_sources(candidates: DataFrame, existing: DataFrame, *, work: str, number: str, priority: list[str]) -> DataFrame:
    """Every part not stored yet, taken from the best source that has it.

    One keep-first replaces the walk over sources; stored parts leave before the shuffle of the rest.
    """
    open_parts = candidates.join(existing.select(work, number).distinct(), [work, number], "left_anti")
    return keep_first(open_parts, key=[work, number], order=priority)


def retry_jobs(dead: DataFrame, works: DataFrame, *, work: str = "work") -> DataFrame:
    """A retry job per dead part: its work's title and site, its canonical file name."""
    joined = dead.join(works.select(work, F.col("title").alias("__work_title"), "site_key"), work)
    job = F.to_json(F.struct(
        F.lit("retry_chapter").alias("type"), F.col("site_key").alias("site"), F.col("url").alias("chapter_url"),
        F.col("title").alias("chapter_title"), F.col("__work_title").alias("story_title"),
        text.part_file_name("title", "index").alias("filename")))
    return joined.select(work, "index", job.alias("value"))


def genre_completeness(listed: DataFrame, completed: DataFrame, *, genre: str = "genre", title: str = "title") -> DataFrame:
    """Per genre the listed works without a completed work of the same title; none left means done."""
    done = completed.select(genre, title).distinct().withColumn("__done", F.lit(True))
    marked = listed.join(done, [genre, title], "left")
    return marked.groupBy(genre).agg(F.count_if(F.col("__done").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)
