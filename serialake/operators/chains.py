"""Listings as chains of landed pages: the next page of every page, and its place in the chain.

Places come from list ranking by pointer doubling: after r rounds a page knows the page 2^r before it, so a chain of n pages takes
log2(n) joins, each on the page, whatever chain it is in; no task follows a chain. A cycle is known after as many rounds and cut before its smallest page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.functions import urls
from serialake.materialise import checkpointed
from serialake.operators import nodes
from serialake.operators.ordering import keep_first


def next_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", pattern: str = "next_pattern", selector: str = "next_selector") -> DataFrame:
    """page_id, url, next_url: from the ``{n}`` pattern of the page's profile, else the first link of its selector; null without either.

    A pattern such as ``?page={n}`` or ``page/{n}`` is filled with the page's own number plus one; a url without the number is page 1.
    """
    rule = F.struct(F.lit("next").alias("field"), F.col(selector).alias("selector"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("container_rank"))
    counted = F.coalesce(F.col(pattern).contains("{n}"), F.lit(False))
    linked = ~counted & (F.coalesce(F.col(pattern), F.lit("")) == "") & F.col(selector).isNotNull()
    found = nodes.find_elements_by_row(F.col(html), F.when(linked, F.array(rule)))
    read = pages.select(page_id, F.col(url).alias("url"), F.col(pattern).alias("p"), counted.alias("counted"), found.alias("found"))
    href = F.array_min(F.transform(F.filter("found", lambda e: F.coalesce(e["href"], F.lit("")) != ""), lambda e: F.struct(e["pos"], e["href"])))["href"]
    shape = F.expr(r"""'^(.*?)[?&/]+\\Q' || ltrim('?&/', substring_index(p, '{n}', 1)) || '\\E([0-9]+)\\Q' || substring_index(p, '{n}', -1) || '\\E$'""")
    cut = read.select(page_id, "url", "p", "counted", href.alias("href"), shape.alias("shape"))
    own = cut.withColumns({"base": F.expr("regexp_extract(url, shape, 1)"), "n": F.expr("try_cast(regexp_extract(url, shape, 2) as bigint)")})
    base = F.regexp_replace(F.when(F.col("n").isNull(), F.col("url")).otherwise(F.col("base")), "/+$", "")
    filled = F.replace(F.col("p"), F.lit("{n}"), (F.coalesce("n", F.lit(1)) + 1).cast("string"))
    sign = F.when(F.col("p").startswith("?"), F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))).otherwise(F.lit("/"))
    numbered = F.concat(base, sign, F.ltrim(filled, F.lit("?/")))
    return own.select(page_id, "url", F.when(F.col("counted"), numbered).when(F.col("href").isNotNull(), urls.absolute_url("url", "href")).alias("next_url"))


def _ranked(before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling on (id, at), a first page pointing at itself: (id, head, place), and (id, low) of the pages in cycles.

    ``low`` is the smallest id of the pages passed so far: it travels along with the pointers. A page that finds itself there has
    passed its whole cycle, as has every page of it in the same round, so cycles leave after log2 of their own length.
    """
    state = checkpointed(before.select("id", "at", (F.col("at") != F.col("id")).cast("bigint").alias("steps"), F.col("at").alias("low"), (F.col("at") == F.col("id")).alias("done")))
    cyclic = state.where("false").select("id", "low")
    while True:
        left, closed = state.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & (F.col("low") == F.col("id")))).first()
        if closed:
            turning, lows = state.where("not done"), state.where("not done and low = id").select("low")
            cyclic = cyclic.unionByName(turning.join(lows, "low", "left_semi").select("id", "low"))
            state = checkpointed(state.where("done").unionByName(turning.join(lows, "low", "left_anti")))
            left = state.where("not done").count()
        if not left:
            return state.select("id", F.col("at").alias("head"), F.col("steps").alias("place")), cyclic
        there = state.where("not done").select(F.col("at").alias("id")).distinct().join(state, "id") \
                     .select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.col("done").alias("first"))
        moved = state.where("not done").join(there, "at").select("id", F.col("beyond").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "lower").alias("low"), F.col("first").alias("done"))
        state = checkpointed(state.where("done").unionByName(moved))


def ranked_pages(links: DataFrame, *, page_id: str = "page_id") -> DataFrame:
    """page_id, url, next_url, listing (url of the first page of its chain), place (from 0), cyclic, for (page_id, url, next_url).

    Of pages with one url the smallest id counts, of pages that lead to one page too: the others' chains end with them. A page of a cycle is
    ranked from the cycle's smallest id on.
    """
    known = checkpointed(keep_first(links.where(F.col(page_id).isNotNull() & F.col("url").isNotNull()), key=["url"], order=[page_id])
                         .select(F.col(page_id).alias("id"), "url", "next_url"))
    steps = known.where("next_url is not null").select(F.col("id").alias("from"), F.col("next_url").alias("url"))
    before = known.join(steps, "url").groupBy("id").agg(F.min("from").alias("at"))
    first = known.select("id").join(before, "id", "left").select("id", F.coalesce("at", "id").alias("at"))
    straight, cyclic = _ranked(first)
    cyclic = checkpointed(cyclic)
    opened = cyclic.join(first, "id").select("id", F.when(F.col("id") == F.col("low"), F.col("id")).otherwise(F.col("at")).alias("at"))
    turned, _ = _ranked(opened)
    # A page that leads to itself is a cycle of one.
    ranks = straight.withColumn("cyclic", F.lit(False)).unionByName(turned.withColumn("cyclic", F.lit(True)))
    heads = known.select(F.col("id").alias("head"), F.col("url").alias("listing"))
    placed = known.join(ranks, "id").join(heads, "head")
    return placed.select(F.col("id").alias(page_id), "url", "next_url", "listing", "place", (F.col("cyclic") | F.col("url").eqNullSafe(F.col("next_url"))).alias("cyclic"))


def listings(ranked: DataFrame) -> DataFrame:
    """listing, pages, cyclic, complete, open_url: a listing is complete when its last page names no next one; else open_url is the next page."""
    last = F.max_by("next_url", "place")
    found = ranked.groupBy("listing").agg(F.count("*").alias("pages"), F.max("cyclic").alias("cyclic"), last.alias("after"))
    return found.select("listing", "pages", "cyclic", (F.col("after").isNull() & ~F.col("cyclic")).alias("complete"), F.when(~F.col("cyclic"), F.col("after")).alias("open_url"))
