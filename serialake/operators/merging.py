"""E9, E10, G2, G3 and I: entity merge, source lists, change detection, repair, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.functions import text, urls
from serialake.functions.text import uni_trim
from serialake.materialise import checkpointed
from serialake.operators.ordering import keep_first
from serialake.operators.running import position

DEFAULT_PRIORITY = 100.0  # fixed value: a source without a priority
CURRENT_PRIORITY = 1.0    # fixed value: the url the work was found under


def _filled(col: Column, kind: str) -> Column:
    """Truthy in the sense of the metadata rules: not null, not '', not 0, not an empty array."""
    if kind == "string":
        return col.isNotNull() & (col != "")
    if kind.startswith("array") or kind.startswith("map"):
        return col.isNotNull() & (F.size(col) > 0)
    if kind == "boolean":
        return F.coalesce(col, F.lit(False))
    return col.isNotNull() & (col != 0)


def upsert(stored: DataFrame, incoming: DataFrame, *, key: Sequence[str], truthy: Sequence[str] = (), not_null: Sequence[str] = (),
           now: Column, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Incoming values overwrite when truthy (``truthy`` fields) or not null (``not_null`` fields).

    ``created`` is kept, ``updated`` is set on every incoming key, ``changed`` tells whether any field differs.
    One full outer join on the key; the wide columns travel once.
    """
    kinds = dict(stored.dtypes)
    fields = [*truthy, *not_null]
    old = stored.select(*key, *fields, created, updated).withColumn("__old", F.lit(True))
    new = incoming.select(*key, *[F.col(f).alias(f"__n_{f}") for f in fields]).withColumn("__new", F.lit(True))
    joined = old.join(new, list(key), "full_outer")
    merged = {f: F.when(_filled(F.col(f"__n_{f}"), kinds[f]), F.col(f"__n_{f}")).otherwise(F.col(f)) for f in truthy}
    merged |= {f: F.coalesce(f"__n_{f}", f) for f in not_null}
    same = F.lit(True)
    for f in fields:
        same = same & merged[f].eqNullSafe(F.col(f))
    arrived = F.coalesce("__new", F.lit(False))
    return joined.select(
        *key, *[merged[f].alias(f) for f in fields], F.coalesce(created, now).alias(created),
        F.when(arrived, now).otherwise(F.col(updated)).alias(updated), (F.col("__old").isNull() | ~same).alias("changed"))


def append_category(categories: Column, *, name: Column, url: Column) -> Column:
    """Add the category unless its url is present, order by lower-case name (stable)."""
    current = F.coalesce(categories, F.array().cast("array<struct<name:string,url:string>>"))
    seen = F.exists(current, lambda c: (c["url"] != "") & c["url"].eqNullSafe(url))
    item = F.struct(name.cast("string").alias("name"), url.cast("string").alias("url"))
    grown = F.when(seen, current).otherwise(F.concat(current, F.array(item)))
    keyed = F.transform(grown, lambda c, i: F.struct(F.lower(F.coalesce(c["name"], F.lit(""))).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def repair_categories(names: Column) -> Column:
    """Categories that are plain strings become (name, null url)."""
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("url")))


def default_categories(categories: Column, fallback: str = "unknown") -> Column:
    """I4: an empty category list gets one default entry."""
    default = F.array(F.struct(F.lit(fallback).alias("name"), F.lit(None).cast("string").alias("url")))
    return F.when(F.coalesce(F.size(categories), F.lit(0)) > 0, categories).otherwise(default)


def default_sources(sources: Column, *, url: Column, site_key: Column) -> Column:
    """I4: an empty source list becomes the work's own url; a missing priority becomes 100."""
    own = F.array(F.struct(url.alias("url"), site_key.alias("site_key"), F.lit(None).cast("double").alias("priority")))
    known = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).when(url.isNotNull() & site_key.isNotNull(), own).otherwise(sources)
    return F.transform(known, lambda s: F.struct(s["url"].alias("url"), s["site_key"].alias("site_key"),
                                                 F.coalesce(s["priority"], F.lit(DEFAULT_PRIORITY)).alias("priority")))


def merge_sources(sources: DataFrame, sites: DataFrame, *, work: str = "work") -> DataFrame:
    """One row per (work, url, site), placed by priority and then by first appearance.

    Input rows: (work, origin, pos, url, priority); origins are numbered in reading order (stored,
    new, stored url, current url). The host decides the site; rows of unknown hosts go. A repeated
    source keeps its first place and its lowest priority.
    """
    cleaned = sources.where(F.coalesce("url", F.lit("")) != "").withColumn("url", uni_trim("url"))
    sited = urls.with_site_key(cleaned, sites, url="url", site_col="__site").where("__site is not null")
    merged = sited.groupBy(work, "url", F.col("__site").alias("site_key")).agg(
        F.min(F.struct("origin", "pos")).alias("first"), F.min("priority").cast("double").alias("priority"))
    keyed = merged.select(work, "url", "site_key", "priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("__p"),
                          F.col("first.origin").alias("__o"), F.col("first.pos").alias("__i"))
    # The merged list is far smaller than its origins and is read several times for its places.
    placed = position(checkpointed(keyed), key=[work], order=["__p", "__o", "__i", "url"], name="place")
    return placed.select(work, "place", "url", "site_key", "priority")


def primary_sources(sources: DataFrame, sites: DataFrame, *, work: str = "work") -> DataFrame:
    """Valid sources in order without repeats; the first one is primary and owns the work.

    Input rows: (work, pos, url, site_key); the work's own url comes as the last position. A source
    is valid when its host is the host of its site (the given one, else the one the host implies).
    """
    sited = urls.with_site_key(sources.where("coalesce(url, '') <> ''"), sites, url="url", site_col="__site")
    valid = sited.where(F.col("__site").isNotNull() & (F.coalesce(F.nullif("site_key", F.lit("")), "__site") == F.col("__site")))
    unique = keep_first(valid.select(work, "pos", "url", F.col("__site").alias("site_key")), key=[work, "url", "site_key"], order=["pos"])
    owners = unique.groupBy(work).agg(F.min(F.struct("pos", "site_key")).alias("__first"))
    joined = unique.join(owners, work)
    return joined.select(work, "pos", "url", "site_key", (F.col("pos") == F.col("__first.pos")).alias("is_primary"),
                         F.col("__first.site_key").alias("owner_key"))


def change_labels(stored: DataFrame, incoming: DataFrame, *, key: Sequence[str], content: str, cleaned: Column | None = None) -> DataFrame:
    """``new``, ``unchanged`` or ``updated`` per incoming key, by SHA-256.

    Both sides are hashed in the same (header-cleaned) form before the join, so only keys and hashes
    are shuffled. Stored content is already clean.
    """
    old = stored.select(*key, text.content_hash(content).alias("__old"))
    fresh = text.content_hash(content if cleaned is None else cleaned)
    new = incoming.select(*key, F.when(F.col(content).isNotNull(), fresh).alias("hash"))
    joined = new.join(old, list(key), "left")
    label = F.when(F.col("hash").isNull(), "rejected").when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("hash"), "unchanged").otherwise("updated")
    return joined.select(*key, "hash", label.alias("label"))


def checked_content(raw: Column) -> Column:
    """I1 input rule for binary content: decode as UTF-8, fail on null."""
    return F.when(F.assert_true(raw.isNotNull(), "content must not be null").isNull(), F.decode(raw, "UTF-8"))


def default_works(folders: DataFrame, works: DataFrame, *, slug: str = "slug", genre: str = "genre", site_key: Column, base_url: Column,
                  counts: str = "saved") -> DataFrame:
    """Folders without metadata get a default row made from their name."""
    absent = folders.join(works.select(slug), slug, "left_anti")
    cats = F.when(F.col(genre).isNotNull(), F.array(F.struct(F.col(genre).alias("name"), F.lit(None).cast("string").alias("url")))) \
            .otherwise(F.array().cast("array<struct<name:string,url:string>>"))
    return absent.select(
        slug, text.title_from_slug(slug).alias("title"),
        F.when(site_key.isNotNull(), F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/"), F.col(slug))).alias("url"),
        F.col(counts).cast("bigint").alias("total"), F.lit("").alias("description"), F.lit("").alias("author"), F.lit("").alias("cover"),
        cats.alias("categories"), F.lit(False).alias("skip_crawl"), site_key.alias("site_key"))


def repair_works(works: DataFrame, *, slug: str = "slug", base_url: Column | None = None, max_retries: int = 3) -> DataFrame:
    """Fill url and title from the sources, the title from the folder, the url from base and folder.

    ``repair`` is ``skip`` (already marked, or url/title cannot be found), ``ok``, ``retry`` (no total yet, retries left) or ``drop``.
    """
    def from_sources(field: str) -> Column:
        filled = F.filter("sources", lambda s: F.coalesce(s[field], F.lit("")) != "")
        return F.try_element_at(filled, F.lit(1)).getField(field)

    blank = F.lit("")
    guessed = F.when(base_url.isNotNull(), F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/"), F.col(slug))) if base_url is not None else F.lit(None).cast("string")
    title = F.coalesce(F.nullif("title", blank), from_sources("title"), F.nullif(text.title_from_slug(slug), blank))
    url = F.coalesce(F.nullif("url", blank), from_sources("url"), guessed)
    has_total = F.coalesce("total", F.lit(0)) >= 1
    status = (F.when(F.coalesce("skip_crawl", F.lit(False)), "skip").when(url.isNull() | title.isNull(), "skip").when(has_total, "ok")
               .when(F.coalesce("retries", F.lit(0)) < max_retries, "retry").otherwise("drop"))
    reason = F.when(~F.coalesce("skip_crawl", F.lit(False)) & (url.isNull() | title.isNull()), "missing_url_title").otherwise(F.col("skip_reason"))
    others = [c for c in works.columns if c not in ("title", "url", "skip_reason")]
    return works.select(*others, title.alias("title"), url.alias("url"), reason.alias("skip_reason"), status.alias("repair"))


def mark_skipped(registry: DataFrame, marks: DataFrame, *, slug: str = "slug", time: Column) -> DataFrame:
    """Skip list with the marks added or replaced, keyed by slug (the first mark of a slug counts)."""
    fresh = keep_first(marks, key=[slug], order=["url", "reason"]).select(slug, "url", "title", "reason").withColumn("time", time)
    kept = registry.join(fresh.select(slug), slug, "left_anti")
    return kept.select(slug, "url", "title", "reason", "time").unionByName(fresh)


def clear_skips(works: DataFrame, restored: DataFrame, *, slug: str = "slug") -> DataFrame:
    """Un-skip clears the flag, the reason and the retry counter."""
    marks = restored.select(slug).distinct().withColumn("__clear", F.lit(True))
    cleared = F.coalesce("__clear", F.lit(False))
    return works.join(marks, slug, "left").withColumn("skip_crawl", F.when(cleared, False).otherwise(F.col("skip_crawl"))) \
                .withColumn("skip_reason", F.when(~cleared, F.col("skip_reason"))) \
                .withColumn("retries", F.when(cleared, 0).otherwise(F.col("retries"))).drop("__clear")


def finished_genres(works: DataFrame, *, genre: str, in_progress: Column, completed: Column) -> DataFrame:
    """Nothing in progress and at least one completed."""
    counts = works.groupBy(genre).agg(F.count_if(in_progress).alias("open"), F.count_if(completed).alias("done"))
    return counts.withColumn("finished", (F.col("open") == 0) & (F.col("done") > 0))
