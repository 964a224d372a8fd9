"""F: counts, completeness, health and reports. Every count is partial before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_counts(parts: DataFrame, *, work: str, saved: Column, dead: Column) -> DataFrame:
    """saved and dead parts per work."""
    return parts.groupBy(work).agg(F.count_if(saved).alias("saved"), F.count_if(dead).alias("dead"))


def expected_total(*, stored: Column, live: Column, limit: Column | None = None) -> Column:
    """greatest positive candidate, each capped by the limit; a limit alone stands in for a missing stored total."""
    def capped(value: Column) -> Column:
        return value if limit is None else F.when(limit >= 0, F.least(value, limit)).otherwise(value)
    stored_total = F.when(stored > 0, capped(stored))
    if limit is not None:
        stored_total = F.coalesce(stored_total, F.when(limit > 0, limit))
    live_total = F.when(live > 0, capped(live))
    return F.nullif(F.greatest(F.coalesce(stored_total, F.lit(0)), F.coalesce(live_total, F.lit(0))), F.lit(0))


def completeness(works: DataFrame, *, saved: str = "saved", dead: str = "dead", expected: str = "expected") -> DataFrame:
    """``complete`` counts dead parts as done; ``report_missing`` does not and leaves out works with nothing saved yet."""
    have, gone, want = F.coalesce(saved, F.lit(0)), F.coalesce(dead, F.lit(0)), F.coalesce(expected, F.lit(0))
    return works.withColumn("complete", (want > 0) & (have + gone >= want)) \
                .withColumn("report_missing", (want > 0) & (have > 0) & (have < want))


def library_summary(works: DataFrame, *, status: str = "status", genre: str = "genre") -> DataFrame:
    """one row of totals; genres are grouped first so the distinct count needs no wide state."""
    by_genre = works.groupBy(genre).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "completed").alias("c"))
    known = F.col(genre).isNotNull() & (F.col(genre) != "Unknown")
    return by_genre.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("c"), F.lit(0)).alias("completed"),
                        F.coalesce(F.sum(F.col("n") - F.col("c")), F.lit(0)).alias("ongoing"), F.count_if(known).alias("genres"))


def top_genres(works: DataFrame, *, genre: str = "genre", n: int = 5) -> DataFrame:
    """the ``n`` genres with most works; ties by name."""
    known = works.where(F.col(genre).isNotNull() & (F.col(genre) != "Unknown"))
    return known.groupBy(genre).agg(F.count("*").alias("works")).orderBy(F.col("works").desc(), genre).limit(n)


def health(works: DataFrame, *, skipped: Column, dead: str = "dead") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, skipped works, works with dead parts)."""
    lost = F.coalesce(dead, F.lit(0))
    totals = works.agg(F.count_if(skipped).alias("skipped_works"), F.coalesce(F.sum(lost), F.lit(0)).alias("dead_parts"),
                       F.count_if(lost > 0).alias("works_with_dead"))
    return totals, works.where(skipped), works.where(lost > 0)


def storage_size(files: DataFrame, *, size: Column) -> DataFrame:
    """total bytes and GiB."""
    total = F.coalesce(F.sum(size.cast("bigint")), F.lit(0))
    return files.agg(total.alias("bytes"), (total / float(1024 ** 3)).alias("gib"))


METRIC_KINDS = ["category", "chapters", "content"]  # fixed values: what a profile is used for
METRIC_OUTCOMES = ["calls", "success", "fail", "cache_hit"]  # fixed values: what is counted


def extraction_metrics(events: DataFrame, *, domain: str, kind: str, outcome: str, time: str) -> DataFrame:
    """per domain one counter for every kind and outcome, and the last use; one pass, no pivot shuffle."""
    counters = [F.count_if((F.col(kind) == k) & (F.col(outcome) == o)).alias(f"{k}_{o}") for k in METRIC_KINDS for o in METRIC_OUTCOMES]
    return events.groupBy(domain).agg(*counters, F.max(time).alias("last_used_at"))


def fetch_outcomes(fetches: DataFrame, *, site: str, outcome: Column) -> DataFrame:
    """F8: primary successes and fallbacks per site; a dead link is neither."""
    tagged = fetches.withColumn("__o", outcome)
    return tagged.groupBy(site).agg(F.count_if(F.col("__o") == "ok").alias("primary_success"),
                                    F.count_if(~F.col("__o").isin("ok", "dead_link")).alias("fallback_count"))


def capped_failures(events: DataFrame, *, key: str | Sequence[str], failed: Column, cap: int) -> DataFrame:
    """failures per key; at the cap the key is dead."""
    keys = [key] if isinstance(key, str) else list(key)
    return events.groupBy(*keys).agg(F.count_if(failed).alias("failures")).withColumn("dead", F.col("failures") >= cap)


def skip_by_failures(works: DataFrame, *, failed: str, total: str) -> Column:
    """at least two thirds of the parts failed."""
    return F.col(failed) >= F.ceil(F.col(total) * 2 / 3)


def paging_completeness(pages: DataFrame, *, group: str, read: str, total: str, attempts: str, max_attempts: int = 5) -> DataFrame:
    """``retry`` while fewer pages were read than announced and attempts are left."""
    short = F.col(read) < F.col(total)
    return pages.select(group, read, total, short.alias("incomplete"), (short & (F.col(attempts) < max_attempts)).alias("retry"))


def refreshed_total(*, stored: Column, observed: Column) -> Column:
    """a positive observation that differs replaces the stored total, otherwise the greater one stays."""
    old, new = F.coalesce(stored, F.lit(0)), F.coalesce(observed, F.lit(0))
    return F.when((new > 0) & (new != old), new).otherwise(F.greatest(old, new))


def library_rows(works: DataFrame, counts: DataFrame, *, work: str, total: str = "total") -> DataFrame:
    """one row per work with its counts and flags."""
    joined = works.join(counts, work, "left").withColumn("saved", F.coalesce("saved", F.lit(0).cast("bigint"))) \
                  .withColumn("dead", F.coalesce("dead", F.lit(0).cast("bigint"))).withColumn("expected", F.col(total))
    return completeness(joined).drop("expected")


HEALTH_STAGES = ["genres", "listings", "detail", "parts", "content"]  # fixed values: order of the checks


def source_health(checks: DataFrame, *, site: str, genres: Column, listings: Column, detail: Column, parts: Column, content: Column) -> DataFrame:
    """per site the first stage that fails (null when healthy)."""
    flags = dict(zip(HEALTH_STAGES, (genres, listings, detail, parts, content)))
    passed = checks.groupBy(site).agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(f"__{k}") for k, v in flags.items()])
    first = F.coalesce(*[F.when(~F.col(f"__{k}"), F.lit(k)) for k in HEALTH_STAGES])
    return passed.select(site, first.alias("failed_stage"), first.isNull().alias("healthy"))
