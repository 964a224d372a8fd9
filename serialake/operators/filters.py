"""D: filters and predicates. All are row-local unless the docstring names a join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.functions import lines, text, urls
from serialake.functions.text import Col, _c, uni_trim


def effective_limit(*, listed: Col, site_total: Col | None = None, caller_cap: Col | None = None, global_cap: int | None = None,
                    max_pages: int | None = None, per_page: int | None = None) -> Column:
    """The smallest cap that is present; without any, the listed count. Never negative."""
    caps = [F.when(_c(listed) > 0, _c(listed))]
    if site_total is not None:
        caps.append(F.when(_c(site_total) > 0, _c(site_total)))
    if caller_cap is not None:
        caps.append(F.when(_c(caller_cap) >= 0, _c(caller_cap)))
    if global_cap:
        caps.append(F.lit(global_cap))
    if max_pages:
        caps.append(F.lit(max_pages * (per_page if per_page and per_page > 0 else 100)))
    smallest = F.least(*[c.cast("bigint") for c in caps]) if len(caps) > 1 else caps[0].cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(smallest, _c(listed).cast("bigint")))


def first_parts(parts: DataFrame, *, pos: str, limit: Column) -> DataFrame:
    """Keep list positions below the limit. ``pos`` is the dense list position, so no ranking is needed."""
    return parts.where(F.col(pos) < limit)


def target_index(*, idx: Column, index: Column, aligned: Column, title: Column) -> Column:
    """Zero-based index a part asks for: idx, else index - 1, else aligned or title number - 1; null when negative or unknown."""
    chosen = F.coalesce(idx, index - 1, F.coalesce(aligned, text.part_number(title)) - 1).cast("bigint")
    return F.when(chosen >= 0, chosen)


def matches_target(targets: Column, *, pos: Column, idx: Column, index: Column, title: Column) -> Column:
    """Any of position, idx, index - 1, title number - 1 is a target; no targets means everything matches."""
    candidates = F.array_compact(F.array(*[c.cast("bigint") for c in (pos, idx, index - 1, text.part_number(title) - 1)]))
    return F.when(targets.isNull() | (F.size(targets) == 0), True).otherwise(F.arrays_overlap(candidates, targets))


def library_filter(works: DataFrame, *, scope: str = "all", genre: str | None = None, min_total: int | None = None,
                   max_total: int | None = None, status_col: str = "status", genre_col: str = "genre", total_col: str = "total") -> DataFrame:
    """Scope, genre substring (case-insensitive) and total bounds; plain predicates that reach the scan."""
    if scope not in ("all", "completed"):
        raise ValueError(f"unknown scope {scope!r}")
    out = works if scope == "all" else works.where(F.col(status_col) == "completed")
    if genre:
        out = out.where(F.lower(genre_col).contains(genre.lower()))
    if min_total is not None:
        out = out.where(F.col(total_col) >= min_total)
    if max_total is not None:
        out = out.where(F.col(total_col) <= max_total)
    return out


def missing_fields(fields: Sequence[str], *, types: dict[str, str] | None = None, falsy: bool = True) -> Column:
    """Names of absent required fields; ``falsy`` also counts '', 0 and empty arrays as absent."""
    types = types or {}

    def absent(name: str) -> Column:
        col, kind = F.col(name), types.get(name, "string")
        if not falsy:
            return col.isNull()
        empty = (F.size(col) == 0) if kind == "array" else (col == 0) if kind == "number" else (col == "")
        return col.isNull() | empty

    return F.array_compact(F.array(*[F.when(absent(name), F.lit(name)) for name in fields]))


def resume(df: DataFrame, *, pos: str, start: Column, cap: int | None = None) -> DataFrame:
    """List positions from the saved offset on, below the cap."""
    out = df.where(F.col(pos) >= F.coalesce(start, F.lit(0)))
    return out if cap is None else out.where(F.col(pos) < cap)


def drop_foreign_sources(sources: DataFrame, sites: DataFrame, *, url: str, site_key: str) -> DataFrame:
    """Keep sources whose host is the host of their own site (a join with the site list)."""
    known = urls.with_site_key(sources, sites, url=url, site_col="__site")
    return known.where(F.col("__site") == F.col(site_key)).drop("__site")


def is_recent(time: Col, *, now: Column, max_age_days: int = 7) -> Column:
    """Younger than N whole days; no time is old, an unreadable time is kept."""
    value = _c(time)
    parsed = F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss"))
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(parsed)) / 86400)
    return F.when(F.coalesce(value, F.lit("")) == "", False).when(parsed.isNull(), True).otherwise(days < max_age_days)


def is_abandoned(*, saved: Col, dead: Col, total: Col, updated_at: Col, now: Column, min_percent: int = 10, days: int = 30) -> Column:
    """Below ``min_percent`` of the parts and untouched for more than ``days`` days; unknown time never is."""
    done = text.percent(F.coalesce(_c(saved), F.lit(0)) + F.coalesce(_c(dead), F.lit(0)), F.coalesce(_c(total), F.lit(0)))
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(_c(updated_at))) / 86400)
    return F.coalesce((done < min_percent) & (age > days), F.lit(False))


def is_empty_object(content: Col) -> Column:
    """Nothing stored (cleanup)."""
    return F.octet_length(F.coalesce(_c(content), F.lit(""))) == 0


def is_too_small(content: Col, minimum: int = 20) -> Column:
    """Fewer bytes than a real part has (repair)."""
    return F.octet_length(F.coalesce(_c(content), F.lit(""))) < minimum


def is_valid_job(fields: Sequence[str]) -> Column:
    """Every required field present and not empty."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f).cast("string"), F.lit("")) != "" for f in fields])


def select_log_lines(log: DataFrame, *, line: str = "line", pattern: str = text.WARNING_LINE) -> DataFrame:
    """Lines where the pattern is found."""
    return log.where(F.col(line).rlike(pattern))


def is_suspicious(saved: Col, expected: Col, share: float = 0.1) -> Column:
    """Far fewer parts than expected, so the parser or the site probably failed."""
    return F.coalesce(_c(saved) < F.lit(share) * _c(expected), F.lit(False))


def fetch_class(*, status: Col, body: Col, error: Col | None = None) -> Column:
    """``ok``, ``dead_link``, ``timeout``, ``anti_bot`` or ``unknown``."""
    status, body = _c(status), _c(body)
    failed = _c(error) if error is not None else F.lit(None).cast("string")
    blocked = lines.is_block_page(body)
    return (
        F.when(F.lower(failed).contains("timeout"), "timeout")
        .when(status == 404, "dead_link")
        .when((status == 200) & (F.coalesce(body, F.lit("")) != "") & ~blocked, "ok")
        .when(blocked, "anti_bot")
        .otherwise("unknown")
    )


def trimmed_not_blank(col: Col) -> Column:
    return F.coalesce(uni_trim(col), F.lit("")) != ""
