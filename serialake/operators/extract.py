"""B: page extraction. Input ``pages(page_id, url, html)``, output one row per thing found.

The wide ``html`` column is consumed by the first projection and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.functions import markup, payload, text, urls
from serialake.operators import nodes
from serialake.operators.ordering import keep_first
from serialake.rules import Rule


def _inline(col: Column) -> Column:
    """Element text on one line."""
    return text.collapse_space(col)


def link_inventory(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
                   base: Column | None = None) -> DataFrame:
    """B1: links of the first rule that yields any named link on a page; one row per url and page."""
    found = pages.select(page_id, F.col(url).alias("__base") if base is None else base.alias("__base"),
                         nodes.find_elements(F.col(html), rules).alias("found"))
    named = F.filter("found", lambda e: (text.genre_name(e["text"]) != "") & (F.coalesce(e["href"], F.lit("")) != ""))
    rows = found.select(page_id, "__base", nodes.best_rank(named).alias("won")) \
                .select(page_id, "__base", F.posexplode_outer("won").alias("pos", "e")).where("e is not null")
    links = rows.select(page_id, "pos", text.genre_name("e.text").alias("name"), urls.absolute_url("__base", "e.href").alias("url"))
    unique = keep_first(links.withColumn("__key", F.lower("url")), key=[page_id, "__key"], order=["pos"])
    return unique.drop("__key")


def listing_link(pages: DataFrame, *, required: Sequence[str], weights: Sequence[tuple[str, str, int]], page_id: str = "page_id",
                 url: str = "url", html: str = "html") -> DataFrame:
    """B2: per page, the link with the highest score (ties: greatest url) among those holding all ``required`` tokens.

    ``weights`` rows are (``href`` or ``text``, expression, points).
    """
    def score(a: Column) -> Column:
        parts = [F.when((a["href"] if where == "href" else F.lower(a["text"])).rlike(pattern), points).otherwise(0)
                 for where, pattern, points in weights]
        total = F.lit(0)
        for part in parts:
            total = total + part
        return total

    def wanted(a: Column) -> Column:
        test = F.lit(True)
        for token in required:
            test = test & a["href"].contains(token)
        return test

    # Best link without a shuffle: the greatest (score, url) of the page's own array.
    ranked = F.transform(F.filter(markup.anchors(F.col(html)), wanted),
                         lambda a: F.struct(score(a).cast("bigint").alias("score"), urls.absolute_url(F.col(url), a["href"]).alias("url")))
    best = pages.select(page_id, F.array_max(ranked).alias("best"))
    return best.where("best is not null").select(page_id, "best.score", "best.url")


def listing_rows(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
                 part_token: str = "/chuong-", attribute_first: bool = False) -> DataFrame:
    """Works listed on a page: title link, latest part, author; one row per work url, in page order.

    Per container and alternative only the first element counts; the title is the first that is not
    a part link, the latest part the first that is. The first container alternative with rows wins.
    A title is the link's text, or its title attribute where the text is empty; with ``attribute_first`` (layouts that cut the
    text short) the attribute wins.
    """
    found = pages.select(page_id, F.col(url).alias("__base"), F.explode(nodes.find_elements(F.col(html), rules)).alias("e"))
    first = found.where("e.nth = 0").select(page_id, "__base", "e.*")
    is_part = F.lower(F.coalesce("href", F.lit(""))).contains(part_token)
    kind = F.col("field")
    names = [F.nullif(_inline(F.col(c)), F.lit("")) for c in (("title", "text") if attribute_first else ("text", "title"))]
    label = F.coalesce(*names, F.lit(""))
    item = F.struct("rank", "pos", label.alias("text"), "href")
    works = first.groupBy(page_id, "__base", "container_rank", "scope").agg(
        F.min(F.when((kind == "title") & ~is_part, item)).alias("t"),
        F.min(F.when((kind == "latest") & is_part, item)).alias("l"),
        F.min(F.when((kind == "author") & (label != ""), item)).alias("a"),
    ).where("t.text <> '' and t.href <> ''")
    rows = works.select(
        page_id, "container_rank", "scope", F.col("t.text").alias("title"), urls.absolute_url("__base", "t.href").alias("url"),
        F.col("l.text").alias("latest_part"), F.when(F.col("l").isNotNull(), urls.absolute_url("__base", "l.href")).alias("latest_part_url"),
        F.col("a.text").alias("author"))
    # A page bounds its own window.
    winning = rows.withColumn("__best", F.min("container_rank").over(W.partitionBy(page_id))).where("container_rank = __best")
    unique = keep_first(winning, key=[page_id, "url"], order=["scope"])
    return unique.select(page_id, F.col("scope").alias("pos"), "title", "url", "latest_part", "latest_part_url", "author")


def work_detail(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
                source: Column | None = None, status_heading: str | None = None, description_separator: str = " ") -> DataFrame:
    """One record per page; single fields take the first element of the best alternative, lists keep order.

    With ``status_heading`` the status is the ``status`` element of the first container whose ``status_heading`` text holds it. A total
    is what the page states, else the last part's number, else the end of its last part range, else the number of its part links.
    """
    found = F.col("found")
    categories = F.transform(
        F.filter(nodes.best_rank(nodes.of_field(found, "category")), lambda e: (e["text"] != "") & e["href"].isNotNull()),
        lambda e: F.struct(_inline(e["text"]).alias("name"), urls.absolute_url(F.col("__base"), e["href"]).alias("url")))
    # Keep the first category per lower-case url: an index test over the page's own short list.
    keys = F.transform(categories, lambda c: F.lower(c["url"]))
    unique_categories = F.filter(F.transform(categories, lambda c, i: F.struct(c["name"].alias("name"), c["url"].alias("url"), i.alias("i"))),
                                 lambda c: F.array_position(keys, F.lower(c["url"])) == c["i"] + 1)
    title = _inline(nodes.first_text(found, "title"))
    # A tail of question marks and dashes is a lost subtitle.
    clean_title = F.when(title.rlike(r"^(.*?) - [\s?-]*[?-][\s?-]*$"), F.regexp_extract(title, r"^(.*?) - ", 1)).otherwise(title)
    stats = ["likes", "views", "follows", "monthly_votes"]
    base = pages.select(page_id, F.col(url).alias("__base"), F.col(html).alias("__html"), nodes.find_elements(F.col(html), rules).alias("found"))
    rate = markup.rating(markup.json_ld(F.col("__html")))
    lines = F.flatten(F.transform(nodes.best_rank(nodes.of_field(found, "description")), lambda e: F.split(e["text"], "\n")))
    described = F.filter(F.transform(lines, _inline), lambda s: s != "")
    status = nodes.first_text(found, "status") if status_heading is None else _beside(found, "status", "status_heading", status_heading)
    links = F.array_distinct(F.transform(F.filter(nodes.best_rank(nodes.of_field(found, "part")), lambda e: e["href"] != ""), lambda e: e["href"]))
    return base.select(
        page_id,
        F.nullif(clean_title, F.lit("")).alias("title"),
        F.nullif(_inline(nodes.first_text(found, "author")), F.lit("")).alias("author"),
        F.nullif(_inline(status), F.lit("")).alias("status"),
        F.array_join(described, description_separator).alias("description"),
        F.when(nodes.first_value(found, "cover").isNotNull(), urls.absolute_url("__base", nodes.first_value(found, "cover"))).alias("cover"),
        F.transform(unique_categories, lambda c: F.struct(c["name"].alias("name"), c["url"].alias("url"))).alias("categories"),
        F.filter(F.transform(nodes.of_field(found, "tag"), lambda e: _inline(e["text"])), lambda s: s != "").alias("tags"),
        F.coalesce(text.digits_as_int(nodes.first_text(found, "total")),
                   F.regexp_extract(nodes.first_value(found, "last_part"), r"([0-9]+)$", 1).try_cast("bigint"),
                   F.array_max(F.transform(ranges_of(found), lambda r: r["to"])), F.nullif(F.size(links).cast("bigint"), F.lit(0))).alias("total_parts"),
        F.coalesce(F.nullif(markup.first_of(F.col("__html"), markup.WORK_ID_PATTERNS[:1]), F.lit("")), F.trim(nodes.first_value(found, "work_id")),
                   markup.first_of(F.col("__html"), markup.WORK_ID_PATTERNS[2:])).alias("work_id"),
        F.trim(nodes.first_value(found, "work_path")).alias("work_path"),
        rate["rating_value"].alias("rating_value"), rate["rating_count"].alias("rating_count"),
        F.map_filter(F.create_map(*[x for s in stats for x in (F.lit(s), text.digits_as_int(nodes.first_text(found, s)))]),
                     lambda _, v: v.isNotNull()).alias("stats"),
        (F.lit(None).cast("string") if source is None else source).alias("source"),
    )


def part_list(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
              detect_newest_first: bool = False) -> DataFrame:
    """Part links of a page in reading order, one row per url.

    Anchors of pagination lists and script links are skipped. With ``detect_newest_first`` the list
    is turned around when its first number exceeds its last, or when fewer than two numbers show.
    The order is decided inside the page's own array.
    """
    found = pages.select(page_id, F.col(url).alias("__base"), nodes.find_elements(F.col(html), rules).alias("found"))
    usable = F.filter(nodes.best_rank(F.col("found")), lambda e: (
        ~F.coalesce(F.array_contains(F.split(e["list_classes"], " "), "pagination"), F.lit(False))
        & (F.coalesce(e["href"], F.lit("")) != "") & ~F.ltrim(e["href"]).startswith("javascript") & (_inline(e["text"]) != "")))
    items = found.select(page_id, F.transform(usable, lambda e: F.struct(
        _inline(e["text"]).alias("title"), urls.absolute_url(F.col("__base"), e["href"]).alias("url"))).alias("items"))
    if detect_newest_first:
        numbers = F.filter(F.transform("items", lambda p: text.label_number(p["title"])), lambda n: n.isNotNull())
        backwards = (F.size(numbers) < 2) | (F.try_element_at(numbers, F.lit(1)) > F.try_element_at(numbers, F.lit(-1)))
        items = items.withColumn("items", F.when(backwards, F.reverse("items")).otherwise(F.col("items")))
    rows = items.select(page_id, F.posexplode_outer("items").alias("pos", "p")).where("p is not null").select(page_id, "pos", "p.title", "p.url")
    return keep_first(rows, key=[page_id, "url"], order=["pos"])


def main_content(pages: DataFrame, rules: Sequence[Rule], noise: Sequence[str], *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Text of the first container alternative that holds any, as escaped paragraphs (null when none)."""
    found = pages.select(page_id, nodes.find_elements(F.col(html), rules, noise).alias("found"))
    filled = F.filter("found", lambda e: e["text"] != "")
    joined = F.array_join(F.transform(nodes.best_rank(filled), lambda e: e["text"]), "\n")
    return found.select(page_id, joined.alias("text"), markup.paragraphs(joined).alias("content"))


def reader_content(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """B8, B10, B7 for pages that carry their text in a script: title, source (``payload`` or ``container``), content, text.

    One tokenising pass gives the scripts and the container. The chosen script's payload is inflated and freed of noise; paragraphs stay,
    breaks become paragraphs, bare text is wrapped line by line. Without a payload the container's text is taken; else all is null.
    """
    plain = nodes.plain_rules(rules)
    key = pages.schema[page_id].dataType.simpleString()
    names = ("title", "fragment", "held")

    def one(page: str | None) -> tuple:
        found = nodes.walk(page, plain, ())
        titles = sorted((e["rank"], e["pos"], e["text"]) for e in found if e["field"] == "title" and e["text"])
        held = [(e["rank"], e["text"]) for e in found if e["field"] == "content" and e["text"]]
        best = min((rank for rank, _ in held), default=None)
        return titles[0][2] if titles else None, payload.fragment_of([e for e in found if e["field"] == "script"]), "\n".join(t for rank, t in held if rank == best) or None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice at a time: an inflated page is many times as large as its payload.
        for batch in batches:
            for some in nodes.slices(batch):
                columns = zip(*[one(page) for page in some.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column("page"), *[pa.array(c, pa.string()) for c in columns]], ["page", *names])

    found = pages.select(F.col(page_id).alias("page"), F.col(html).alias("html")).mapInArrow(read, f"page {key}, title string, fragment string, held string")
    part = found.select(F.col("page").alias(page_id), "title", "held", F.trim(markup.squeeze_breaks("fragment")).alias("fragment"))
    pieces = F.filter(F.transform(F.split("fragment", r"(?i)<br\s*/?>"), lambda x: text.uni_trim(x)), lambda x: x != "")
    wrapped = F.array_join(F.transform(pieces, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    lower = F.lower("fragment")
    content = F.when(lower.contains("<p"), F.col("fragment")).when(lower.contains("<br"), wrapped).otherwise(markup.paragraphs(markup.text_blocks("fragment")))
    read_pages = part.select(page_id, F.nullif(_inline(F.col("title")), F.lit("")).alias("title"), F.nullif(content, F.lit("")).alias("inflated"), "held")
    kind = F.when(F.col("inflated").isNotNull(), "payload").when(F.col("held").isNotNull(), "container")
    shown = F.when(kind == "payload", markup.text_blocks("inflated")).otherwise(F.col("held"))
    return read_pages.select(page_id, "title", kind.alias("source"), F.coalesce("inflated", markup.paragraphs("held")).alias("content"), shown.alias("text"))


def _beside(found: Column, field: str, heading: str, phrase: str) -> Column:
    """Text of the first ``field`` element in the first container whose first ``heading`` element holds ``phrase`` (and that has one)."""
    headed = F.transform(F.filter(found, lambda e: (e["field"] == heading) & (e["nth"] == 0) & e["text"].contains(phrase)), lambda e: e["scope"])
    held = F.filter(found, lambda e: (e["field"] == field) & (e["nth"] == 0) & F.array_contains(headed, e["scope"]))
    return F.array_min(F.transform(held, lambda e: F.struct(e["scope"], e["text"])))["text"]


def _range(label: Column, other: Column | None = None) -> Column:
    """(from, to) of the first two integers of a label, else of the other text; null without any."""
    def numbers(value: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"([0-9]+)"), F.lit(1)), lambda s: s.try_cast("bigint"))

    found = numbers(label) if other is None else F.when(F.size(numbers(label)) > 0, numbers(label)).otherwise(numbers(other))
    a = F.try_element_at(found, F.lit(1))
    b = F.coalesce(F.try_element_at(found, F.lit(2)), a)
    return F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))


def _ranges(made: Column) -> Column:
    """Ranges in order without empty ones and without a repeat of the one before."""
    filled = F.filter(made, lambda r: r["from"].isNotNull())
    start = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return F.aggregate(filled, start, lambda done, r: F.when(F.try_element_at(done, F.lit(-1)).eqNullSafe(r), done).otherwise(F.array_append(done, r)))


def ranges_of(found: Column) -> Column:
    """Part ranges of a page's collapsible groups: the anchor's label, else the group's text, else its ``data-value``."""
    anchors = F.filter(nodes.of_field(found, "range"), lambda e: e["nth"] == 0)

    def one(group: Column) -> Column:
        label = F.array_max(F.transform(F.filter(anchors, lambda a: a["scope"] == group["pos"]), lambda a: a["text"]))
        return _range(F.coalesce(label, group["text"]), group["value"])

    return _ranges(F.transform(nodes.of_field(found, "range_value"), one))


def page_ranges(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(from, to) of every group of a page, in page order."""
    found = pages.select(page_id, nodes.find_elements(F.col(html), rules).alias("found"))
    return found.select(page_id, F.posexplode(ranges_of(F.col("found"))).alias("pos", "r")).select(page_id, "pos", "r.from", "r.to")


def part_ranges(df: DataFrame, *, labels: Column, keep: Sequence[str]) -> DataFrame:
    """(from, to) of each label: one or two integers, swapped when reversed, consecutive repeats dropped.

    ``labels`` is an array of label strings in page order; a label without digits gives nothing.
    """
    return df.select(*keep, F.posexplode(_ranges(F.transform(labels, lambda s: _range(s)))).alias("pos", "x")).select(*keep, "pos", "x.from", "x.to")


def sorted_ranges(col: Column) -> Column:
    """B12, second step: normalise an array of (from, to) structs, swap reversed ends, sort."""
    def ordered(r: Column) -> Column:
        start = r["from"].try_cast("bigint")
        end = F.coalesce(r["to"].try_cast("bigint"), start)
        return F.when(start.isNotNull(), F.struct(F.least(start, end).alias("from"), F.greatest(start, end).alias("to")))

    return F.array_sort(F.array_compact(F.transform(col, ordered)))


def live_profiles(pages: DataFrame, profiles: DataFrame, *, now: Column, url: str = "url") -> DataFrame:
    """Pages with the unexpired profile of their host (age up to ``ttl_hours``)."""
    valid = profiles.where((now - F.col("detected_at")) <= F.col("ttl_hours").cast("bigint") * 3600)
    return pages.withColumn("__host", urls.host(url)).join(valid, F.col("__host") == F.lower("domain")).drop("__host")


def profile_listing(pages_with_profile: DataFrame, *, rules: Column, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Items of a page by the selectors of its own profile; the title falls back to ``untitled``."""
    found = pages_with_profile.select(page_id, F.explode(nodes.find_elements_by_row(F.col(html), rules)).alias("e")) \
                              .where("e.nth = 0").select(page_id, "e.*")
    item = F.struct("pos", "text", "href", "title")
    kind = F.col("field")
    rows = found.groupBy(page_id, "scope").agg(F.min(F.when(kind == "link", item)).alias("l"), F.min(F.when(kind == "title", item)).alias("t"),
                                               F.min(F.when(kind == "author", item)).alias("a")).where("l.href <> ''")
    blank = F.lit("")
    title = F.coalesce(F.nullif(_inline(F.col("t.text")), blank), F.nullif(F.col("l.title"), blank), F.nullif(_inline(F.col("l.text")), blank),
                       F.lit("untitled"))
    return rows.select(page_id, F.col("scope").alias("pos"), title.alias("title"), F.col("l.href").alias("url"),
                       F.nullif(_inline(F.col("a.text")), blank).alias("author"))


def profile_content(pages_with_profile: DataFrame, *, selector: str = "content_selector", noise: Sequence[str] = ("script", "style"), page_id: str = "page_id",
                    html: str = "html") -> DataFrame:
    """Text of the first element that the ``content_selector`` of a page's own profile finds, and as paragraphs; null without one."""
    rule = F.struct(F.lit("content").alias("field"), F.col(selector).alias("selector"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("container_rank"))
    found = pages_with_profile.select(page_id, nodes.find_elements_by_row(F.col(html), F.when(F.col(selector).isNotNull(), F.array(rule)), noise).alias("found"))
    return found.select(page_id, nodes.first_text(F.col("found"), "content").alias("text")).select(page_id, "text", markup.paragraphs("text").alias("content"))


def next_page_url(url: Column, pattern: Column, next_href: Column, page: int = 2) -> Column:
    """Url of the next page from a ``{n}`` pattern, else the next link."""
    base = F.regexp_replace(url, "/+$", "")
    filled = F.replace(pattern, F.lit("{n}"), F.lit(str(page)))
    query = F.concat(base, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.regexp_replace(filled, r"^\?+", ""))
    path = F.concat(base, F.lit("/"), F.regexp_replace(filled, "^/+", ""))
    return F.when(pattern.contains("{n}"), F.when(pattern.startswith("?"), query).otherwise(path)) \
            .when(F.coalesce(pattern, F.lit("")) == "", next_href)


def latest_parts(pages: DataFrame, rules: Sequence[Rule], *, phrase: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Part links of the first section whose heading contains ``phrase`` and that has any, chosen inside the page's own array."""
    found = pages.select(page_id, F.col(url).alias("__base"), nodes.find_elements(F.col(html), rules).alias("found"))
    headed = F.filter("found", lambda e: (e["field"] == "heading") & (e["nth"] == 0) & F.lower(_inline(e["text"])).contains(phrase.lower()))
    filled = F.filter("found", lambda e: e["field"] == "part")
    scope = lambda e: e["scope"]
    chosen = found.withColumn("first", F.array_min(F.array_intersect(F.transform(headed, scope), F.transform(filled, scope))))
    parts = F.filter("found", lambda e: (e["field"] == "part") & (e["scope"] == F.col("first")) & (e["href"] != "") & (e["text"] != ""))
    rows = chosen.select(page_id, "__base", F.explode_outer(parts).alias("e")).where("e is not null")
    return rows.select(page_id, "e.pos", _inline(F.col("e.text")).alias("title"), urls.absolute_url("__base", "e.href").alias("url"))
