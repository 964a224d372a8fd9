"""Extraction rules as configuration rows: which elements of a page play which role.

A rule says: inside ``container`` (optional), elements matching ``selector`` are ``field``.
``container_rank`` and ``rank`` order alternatives; the operators decide which rank wins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.functions.lines import split_rules

RULE_TYPE = "struct<field:string,selector:string,rank:int,container:string,container_rank:int>"


@dataclass(frozen=True)
class Rule:
    field: str
    selector: str
    rank: int = 0
    container: str | None = None
    container_rank: int = 0


def _ranked(field: str, selectors: Iterable[str], container: str | None = None, container_rank: int = 0) -> list[Rule]:
    return [Rule(field, s, i, container, container_rank) for i, s in enumerate(selectors)]


# --- fixed values: rules of the two supported page layouts ("catalog" and "reader") ---------
CATALOG_GENRES = _ranked("link", [
    "header a[href^='/the-loai/']",
    "nav a[href^='/the-loai/']",
    "div.nav-list a[href^='/the-loai/']",
    "a[href*='/the-loai/']",
])
READER_GENRES = _ranked("link", [
    "li#menu-item-787939 ul.sub-menu a[href]",
    "li.menu-item a[href*='/theloai/']",
])

_CATALOG_CONTAINERS = [
    "div.update-list table tbody tr",
    "div.update-list div.book-wrap, div.update-list li, div.book-list li, div.update-list div.story-card",
]
_CATALOG_TITLES = ["a.name[href]", "a.book-name[href]", "a.bookTitle[href]", "h3 a[href]", "h4 a[href]", "a[href]"]
_CATALOG_LATEST = ["a.section[href]", "a.chapter[href]", "a[href]"]
_CATALOG_AUTHORS = ["a.author", "a.writer", "span.author", "p.author a", "p.author"]


def listing_rules(containers: list[str], titles: list[str], latest: list[str], authors: list[str]) -> list[Rule]:
    return [rule for i, c in enumerate(containers)
            for rule in (*_ranked("title", titles, c, i), *_ranked("latest", latest, c, i), *_ranked("author", authors, c, i))]


CATALOG_LISTING = [
    *listing_rules(_CATALOG_CONTAINERS, _CATALOG_TITLES, _CATALOG_LATEST, _CATALOG_AUTHORS),
    # Last resort: any work link, the element around it is the container.
    *[Rule(r.field, r.selector, r.rank, r.container, 2)
      for r in listing_rules([":parent(a[href*='/doc-truyen/'])"], _CATALOG_TITLES, _CATALOG_LATEST, _CATALOG_AUTHORS)],
]
READER_LISTING = listing_rules(["div.popular-item-wrap"], ["h5.widget-title a[href]"], [], [])
SCHEMA_LISTING = listing_rules(["[itemtype='https://schema.org/Book']"], ["[itemprop='name'] a[href]", "a[itemprop='url']", "a[href]"], [],
                               ["[itemprop='author']"])

CATALOG_DETAIL = [
    Rule("title", "div.book-info h1"),
    Rule("author", "p.tag a.blue"),
    Rule("status", "p.tag span.blue"),
    Rule("description", "div.book-info p.intro, p.intro"),
    Rule("description", "div#bookDetail, div.book-detail", 1),
    Rule("cover", "div.book-img img[src]"),
    Rule("category", "p.tag a.red"),
    Rule("category", "div.crumbs-nav a[href*='/the-loai/']", 1),
    Rule("work_id", "meta[name='book_detail']"),
    Rule("work_id", "input#story_id_hidden[value]", 1),
    Rule("work_path", "meta[name='book_path']"),
    Rule("total", "a#j-bookCatalogPage"),
    Rule("tag", "a.tags, .tags a[href*='/tong-hop?tag=']"),
    Rule("likes", "span.ULtwOOTH-like"),
    Rule("views", "span.ULtwOOTH-view"),
    Rule("follows", "span.ULtwOOTH-follow"),
    Rule("monthly_votes", "span.ULtwOOTH-nomi"),
]
READER_DETAIL = [
    Rule("title", ".post-title h1, h1.post-title, h1.entry-title"),
    Rule("author", ".author-content a, .author-name a"),
    Rule("status_heading", ".summary-heading h3", 0, ".post-content_item"),
    Rule("status", ".summary-content div", 0, ".post-content_item"),
    Rule("description", ".description-summary .summary__content"),
    Rule("cover", ".summary_image img, .tab-summary img, .summary_image a img"),
    Rule("category", ".genres-content a[href]"),
    Rule("work_id", "input.rating-post-id[value]"),
    Rule("last_part", "ul.main.version-chap[data-last]"),
]

CATALOG_PARTS = [Rule("part", "ul.cf li a[href]"), Rule("part", "ul li a[href]", 1)]
READER_PARTS = [
    Rule("part", "ul.version-chap li a[href]"),
    Rule("part", "ul.main li.wp-manga-chapter a[href]", 1),
    Rule("part", "li.wp-manga-chapter a[href]", 2),
]
READER_STATUS_HEADING = "Trạng thái"
READER_RANGES = [
    Rule("range", "a.has-child", 0, "ul.version-chap > li.has-child[data-value]"),
    Rule("range_value", "ul.version-chap > li.has-child[data-value]"),
]
READER_DETAIL += [*READER_RANGES, *READER_PARTS]

CATALOG_CONTENT = [
    Rule("content", "div.chapter-c-content div.box-chap"),
    Rule("content", "div.chapter-c-content", 1),
    Rule("content", "div#chapter-content, div.chapter-content", 2),
]
CATALOG_CONTENT_NOISE = [".left-control", ".panel-box", ".panel-setting", ".panel-catalog", ".chapter-comment", "script", "style"]
READER_CONTENT = [
    Rule("script", "script#decompress-script"),
    Rule("script", "script", 1),
    Rule("title", "h2"),
    Rule("title", "h1#chapter-heading", 1),
    Rule("content", "#chapter-reading-content"),
]

LATEST_PARTS = [Rule("heading", "h3", 0, "div.volume-wrap div.volume"), Rule("part", "ul li a[href]", 0, "div.volume-wrap div.volume")]


# --- profiles and sites ---------------------------------------------------------------------
PROFILE_SCHEMA = ("domain string, detected_at bigint, ttl_hours int, item_selector string, link_selector string, "
                  "title_selector string, author_selector string, next_pattern string, next_selector string, content_selector string")


def profile_rules() -> Column:
    """Rules of one profile row as ``array<rule>`` (a column, so each page carries its own)."""
    def rule(field: str, selector: str) -> Column:
        return F.struct(F.lit(field).alias("field"), F.col(selector).alias("selector"), F.lit(0).alias("rank"),
                        F.col("item_selector").alias("container"), F.lit(0).alias("container_rank"))
    rules = F.array(rule("link", "link_selector"), rule("title", "title_selector"), rule("author", "author_selector"))
    return F.filter(rules, lambda r: r["selector"].isNotNull())


class Sites:
    """K1/K2: what is known about each site: base url, page-size hint and its rules per page kind.

    Rules are data, so a new site is a new row. Sites that need code of their own bring an extractor (``operators.plugins``).
    """

    def __init__(self) -> None:
        self._sites: dict[str, dict] = {}

    def register(self, site_key: str, base_url: str, *, page_size: int = 100, **rules: list[Rule]) -> None:
        self._sites[site_key] = {"base_url": base_url, "page_size": page_size, "rules": rules}

    def keys(self) -> list[str]:
        return list(self._sites)

    def rules(self, site_key: str, kind: str) -> list[Rule]:
        return self._sites[site_key]["rules"].get(kind, [])

    def rules_by_site(self, kind: str) -> Column:
        """``map<site_key, array<rule>>`` literal for one page kind."""
        pairs = []
        for key in self._sites:
            structs = [F.struct(F.lit(r.field).alias("field"), F.lit(r.selector).alias("selector"), F.lit(r.rank).alias("rank"),
                                F.lit(r.container).alias("container"), F.lit(r.container_rank).alias("container_rank"))
                       for r in self.rules(key, kind)]
            pairs += [F.lit(key), (F.array(*structs) if structs else F.array()).cast(f"array<{RULE_TYPE}>")]
        return F.create_map(*pairs)


MOST_PATTERNS = 10_000


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """A4/K3: one rule per line; blank lines and lines starting with ``#`` are dropped.

    A rule file is small configuration by contract, so it becomes a list for a literal expression; a file with more than
    ``MOST_PATTERNS`` rules is refused before it reaches the driver.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.trim("value").alias("v")).where("v <> ''")
    rows = lines.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"{path}: more than {MOST_PATTERNS} rules")
    return [r["v"] for r in rows]


def read_split_patterns(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """A4, second form: (regular expressions, lower-case literals)."""
    return split_rules(read_patterns(spark, path))
