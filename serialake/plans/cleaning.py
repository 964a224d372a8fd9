"""From raw pages to clean text, blocked and empty pages set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake import fixed
from serialake.functions import lines, markup, urls
from serialake.operators import nodes
from serialake.rules import Rule


def clean_text(fragment: Column, patterns: Sequence[str] = tuple(fixed.BLACKLIST_PATTERNS)) -> Column:
    """Container markup without code to clean text: one block per line, rule lines and leading headers out."""
    return lines.drop_leading_headers(lines.filter_lines(markup.text_blocks(fragment), patterns))


def clean_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", tag: str = "article",
                patterns: Sequence[str] = tuple(fixed.BLACKLIST_PATTERNS)) -> DataFrame:
    """B16 where a regular expression finds the container: one JVM-side projection, no Python, no shuffle."""
    body = markup.container(markup.strip_code(F.col(html)), tag)
    return pages.select(page_id, urls.host(url).alias("host"), lines.is_block_page(html).alias("blocked"), body.alias("__body")) \
                .select(page_id, "host", "blocked", F.col("__body").isNotNull().alias("has_container"), clean_text(F.col("__body"), patterns).alias("text"))


CONTENT_HEURISTIC = Rule("content", "div[id*='chapter-c']")


def clean_pages_by_rules(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
                         patterns: Sequence[str] = tuple(fixed.BLACKLIST_PATTERNS),
                         noise: Sequence[str] = ("script", "style", "[class*='ads']", "[class*='notice']")) -> DataFrame:
    """B16 with the container chain: id heuristic first, then site rules, then profile rules, in rank order."""
    chain = [CONTENT_HEURISTIC, *[Rule(r.field, r.selector, i + 1, r.container, r.container_rank) for i, r in enumerate(rules)]]
    found = pages.select(page_id, urls.host(url).alias("host"), lines.is_block_page(html).alias("blocked"),
                         nodes.find_elements(F.col(html), chain, noise).alias("found"))
    content = nodes.first_text(F.col("found"), "content")
    return found.select(page_id, "host", "blocked", (F.size("found") > 0).alias("has_container"),
                        lines.drop_leading_headers(lines.filter_lines(content, patterns)).alias("text"))


def quarantine(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, pages set aside with the reason)."""
    reason = (F.when(~F.col("has_container"), "no_container").when(F.coalesce("text", F.lit("")) == "", "empty_after_cleaning")
               .when(F.col("blocked"), "blocked"))
    tagged = cleaned.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def summarise_hosts(cleaned: DataFrame) -> DataFrame:
    """Pages, characters and blocked pages per host; partial sums before the only shuffle."""
    return cleaned.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.count_if("blocked").alias("blocked_pages"))
