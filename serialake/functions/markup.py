"""Markup functions that regular expressions can express exactly; they stay in the JVM.

Structure that needs a tree (nested blocks, selector chains) is in ``operators.nodes``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from serialake.functions.text import Col, _c, collapse_space, unescape, uni_trim

CODE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>"""


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null instead of ''."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def decode_utf8(raw: Col) -> Column:
    """Bytes to text, malformed sequences replaced."""
    return F.make_valid_utf8(_c(raw).cast("string"))


def strip_code(html: Col) -> Column:
    """Remove scripts, styles and comments."""
    return F.regexp_replace(_c(html), CODE, "")


def strip_flat_blocks(html: Col, class_words: Sequence[str], tag: str = "div") -> Column:
    """Remove ``tag`` blocks whose class list holds a flagged word, for blocks without inner ``tag``.

    Blocks that nest need ``payload.remove_noise`` (same rule, tree-aware).
    """
    words = "|".join(re.escape(w).replace("\\-", "-") for w in class_words)
    block = (rf"""(?is)<{tag}\b[^>]*\bclass\s*=\s*["']?[^"'>]*(?:{words})[^>]*>"""
             rf"(?:(?!</?{tag}\b).)*+</{tag}\s*>")
    return F.regexp_replace(_c(html), block, "")


def squeeze_breaks(html: Col) -> Column:
    """Two or more ``<br>`` become exactly two."""
    return F.regexp_replace(_c(html), r"(?i)(?:&nbsp;)*(?:\s*<br\s*/?>\s*){2,}", "<br><br>")


def strip_tags(html: Col, separator: str = "") -> Column:
    """Every run of tags becomes ``separator``."""
    return F.regexp_replace(_c(html), r"(?:<[^>]*>)+", separator)


def fragment_to_text(html: Col) -> Column:
    """Text of a fragment; breaks and tags end lines, lines are trimmed, blank runs shrink to one.

    A ``<br>`` is a text node of its own, so it leaves one blank line behind.
    """
    text = F.regexp_replace(F.coalesce(_c(html), F.lit("")), r"(?i)<br\s*/?>", "\n\n\n")
    text = unescape(strip_tags(text, "\n"))
    text = F.translate(text, " \r", " \n")
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return uni_trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def text_blocks(html: Col) -> Column:
    """As ``fragment_to_text`` but no blank lines at all (code is expected to be out already)."""
    return F.regexp_replace(fragment_to_text(html), r"\n{2,}", "\n")


def page_title(html: Col) -> Column:
    return collapse_space(unescape(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def heading(html: Col, level: int = 1) -> Column:
    inner = F.regexp_extract(_c(html), rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", 1)
    return collapse_space(unescape(strip_tags(inner, " ")))


def page_language(html: Col) -> Column:
    return _first(_c(html), r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""")


def body_html(html: Col) -> Column:
    """Inner markup of ``<body>``; null when the page has none (an unclosed body runs to the end)."""
    return _first(_c(html), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)")


def container(html: Col, tag: str = "article") -> Column:
    """Inner markup of the first ``tag`` element; null when absent or empty."""
    return _first(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")


def paragraphs(text: Col) -> Column:
    """Each non-empty line re-wrapped as an escaped paragraph; null when nothing is left."""
    from serialake.functions.text import escape

    lines = F.filter(F.transform(F.split(_c(text), r"\r?\n+"), uni_trim), lambda s: s != "")
    return F.nullif(F.array_join(F.transform(lines, lambda s: F.concat(F.lit("<p>"), escape(s), F.lit("</p>"))), ""),
                    F.lit(""))


def anchors(html: Col) -> Column:
    """Anchors in page order: ``array<struct<href, text>>`` from a regular expression."""
    found = F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(0))
    return F.transform(found, lambda a: F.struct(
        unescape(F.concat(*[F.regexp_extract(a, ANCHOR, g) for g in (1, 2, 3)])).alias("href"),
        collapse_space(unescape(strip_tags(F.regexp_extract(a, ANCHOR, 4), " "))).alias("text"),
    ))


def page_count(html: Col) -> Column:
    """Largest page number announced by links and paths, by the options of a ``select``, by ``data-page``, or by
    digit-only anchors of ``ul.pagination``; at least 1. Numbers elsewhere (a year link, a stray option) do not count.
    """
    html = F.coalesce(_c(html), F.lit(""))
    inside = {name: F.array_join(F.regexp_extract_all(html, F.lit(p), F.lit(1)), "\n") for name, p in {
        "select": r"(?is)<select\b[^>]*>(.*?)(?:</select\s*>|\z)",
        "pagination": r"""(?is)<ul\b[^>]*(?<![\w-])class\s*=\s*["']?(?:[^"'>]*\s)?pagination(?=[\s"'>])[^>]*>(.*?)(?:</ul\s*>|\z)""",
    }.items()}
    numbers = [
        F.regexp_extract_all(part, F.lit(p), F.lit(group))
        for part, p, group in (
            (html, r"""(?i)href\s*=\s*["']?[^"'>]*?\bpage=([0-9]+)""", 1),
            (html, r"""(?i)href\s*=\s*["']?[^"'>]*?/(?:trang-|page/)([0-9]+)""", 1),
            (html, r"""(?i)(?<![\w-])data-page\s*=\s*(["']?)([0-9]+)\1(?=[\s/>])""", 2),
            (inside["select"], r"""(?i)<option\b[^>]*(?<![\w-])value\s*=\s*(["']?)([0-9]+)\1(?=[\s/>])""", 2),
            (inside["pagination"], r"""(?i)<a\b[^>]*>\s*([0-9]+)\s*</a""", 1),
        )
    ]
    found = F.transform(F.concat(*numbers), lambda s: s.try_cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.array_max(found))


def url_page_number(url: Col) -> Column:
    """B4 on a url: its own page number, 1 when it has none."""
    url = F.coalesce(_c(url), F.lit(""))
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(
        F.regexp_extract(url, r"page=([0-9]+)", 1).try_cast("bigint"),
        F.regexp_extract(url, r"/(?:trang-|page/)([0-9]+)", 1).try_cast("bigint"),
    ))


def json_ld(html: Col) -> Column:
    """First ``application/ld+json`` script body."""
    return _first(_c(html), r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script""")


def rating(payload: Col) -> Column:
    """Rating value and count of a JSON-LD payload, as text; bad JSON gives nulls."""
    def at(name: str) -> Column:
        return F.nullif(F.get_json_object(_c(payload), f"$.aggregateRating.{name}"), F.lit(""))
    # A zero review count is falsy where the rule comes from, so the rating count takes over.
    reviews = F.nullif(at("reviewCount"), F.lit("0"))
    return F.struct(at("ratingValue").alias("rating_value"),
                    F.coalesce(reviews, at("ratingCount")).alias("rating_count"))


# Identifier patterns, tried in order.
NONCE_PATTERNS = [
    r'(?i)ajax_nonce"\s*:\s*"([^"]+)"',
    r'(?i)"nonce"\s*:\s*"([^"]+)"',
    r'(?i)data-nonce\s*=\s*"([^"]+)"',
    r'(?i)"security"\s*:\s*"([^"]+)"',
]
WORK_ID_PATTERNS = [
    r'(?i)"manga_id"\s*:\s*"?([0-9]+)"?',
    r'(?i)<input\b[^>]*class="[^"]*rating-post-id[^"]*"[^>]*value="([^"]+)"',
    r'(?i)<body\b[^>]*class="[^"]*\bpostid-([^"\s]+)',
]


def first_of(col: Col, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[_first(_c(col), p) for p in patterns])


def tag_counters(html: Col, tags: Sequence[str]) -> Column:
    """B14 (markup form): tag name to number of opening tags, zero counts left out."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(t) for t in tags]),
        F.array(*[F.regexp_count(_c(html), F.lit(rf"(?i)<{t}\b")).cast("bigint") for t in tags]),
    )
    return F.map_filter(counts, lambda _, n: n > 0)


def class_counters(html: Col, classes: dict[str, str]) -> Column:
    """Number inside the first ``span`` of each class, as ``map<name, bigint>``; absent ones left out."""
    from serialake.functions.text import digits_as_int

    values = [digits_as_int(_first(_c(html), rf"""(?is)<span\b[^>]*class\s*=\s*["']?[^"'>]*\b{re.escape(c)}\b[^>]*>(.*?)</span"""))
              for c in classes]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in classes.values()]), F.array(*values)),
                        lambda _, v: v.isNotNull())


def trim_to_bytes(html: Col, max_bytes: int) -> Column:
    """Body without code, cut at ``max_bytes`` bytes on a character boundary."""
    bare = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")
    body = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?is)(<body\b.*?(?:</body\s*>|\z))", 1), F.lit("")), bare)
    cut = F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, max_bytes).cast("string"))
    return F.when(F.octet_length(body) <= max_bytes, body).otherwise(F.regexp_replace(cut, "�+$", ""))
