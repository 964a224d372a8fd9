"""Line-level cleaning and page classification (all inside the row, no explode, no shuffle)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from serialake import fixed
from serialake.functions.text import Col, _c, let, uni_trim

_META = re.compile(r"[\\.^$*+?{}\[\]|()]")


def split_lines(col: Col) -> Column:
    """Lines of a text, any Unicode line break."""
    return F.split(F.coalesce(_c(col), F.lit("")), r"\R", -1)


def is_literal(pattern: str) -> bool:
    return not _META.search(pattern)


def split_rules(patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Separate a rule list into (regular expressions, lower-case literals)."""
    regexes = [p for p in patterns if not is_literal(p)]
    literals = [p.lower() for p in patterns if is_literal(p)]
    return regexes, literals


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _expression(regexes: Sequence[str]) -> str:
    """One case-insensitive alternation; anchored rules share one ``^`` so they fail fast elsewhere."""
    anchored = [p[1:] for p in regexes if p.startswith("^")]
    free = [p for p in regexes if not p.startswith("^")]
    parts = ([f"^(?:{'|'.join(f'(?:{p})' for p in anchored)})"] if anchored else []) + [f"(?:{p})" for p in free]
    return "(?iu)(?U)" + "|".join(parts)


def matches_any(line: Col, patterns: Sequence[str], lowered: Column | None = None) -> Column:
    """True when any rule is found somewhere in the line, case-insensitively.

    Literals are plain substring searches in the lower-cased line, an order of magnitude cheaper
    than a long alternation; the rest keep their own syntax under ``(?iu)``.
    """
    line = _c(line)
    regexes, literals = split_rules(patterns)
    low = F.lower(line) if lowered is None else lowered
    tests = [low.contains(word) for word in dict.fromkeys(literals)]
    if regexes:
        tests.append(line.rlike(_expression(regexes)))
    return _any(tests)


def filter_lines(text: Col, patterns: Sequence[str] = tuple(fixed.BLACKLIST_PATTERNS)) -> Column:
    """Kept, trimmed lines joined with newlines.

    A line goes when it is blank, when a rule is found in it, or when it is short and not properly
    ended. Each line is trimmed and lower-cased once.
    """
    endings = "".join(re.escape(e) for e in fixed.SHORT_LINE_ENDINGS)
    prepared = F.transform(split_lines(text), lambda raw: uni_trim(raw))
    prepared = F.transform(prepared, lambda line: F.struct(line.alias("line"), F.lower(line).alias("low")))

    def keep(item: Column) -> Column:
        line = item["line"]
        return ((line != "") & ~matches_any(line, patterns, item["low"])
                & ((F.length(line) >= fixed.SHORT_LINE_LENGTH) | line.rlike(f"[{endings}]$")))

    return F.array_join(F.transform(F.filter(prepared, keep), lambda item: item["line"]), "\n")


def drop_leading_headers(text: Col, prefixes: Sequence[str] = tuple(fixed.HEADER_PREFIXES)) -> Column:
    """D3: blank lines go everywhere; header lines go until the first other line."""
    longest = max(len(p) for p in prefixes)
    filled = F.filter(split_lines(text), lambda line: uni_trim(line) != "")

    def is_header(line: Column) -> Column:
        start = F.lower(F.left(uni_trim(line), F.lit(longest)))
        return _any([start.startswith(p.lower()) for p in prefixes])

    def from_first_body(all_lines: Column) -> Column:
        # Position 0 means that every line is a header; the slice then starts behind the end.
        first = F.array_position(F.transform(all_lines, is_header), False).cast("int")
        start = F.coalesce(F.nullif(first, F.lit(0)), F.size(all_lines) + 1)
        return F.array_join(F.slice(all_lines, start, F.size(all_lines)), "\n")

    return uni_trim(let(filled, from_first_body))


def is_block_page(html: Col) -> Column:
    """Challenge or block page.

    Cheap phrase tests come first and decide alone below 100 characters; then the title, then a
    body of fewer than 50 words that asks for JavaScript. Words are counted on tag-separated text.
    """
    from serialake.functions.markup import body_html, page_title, strip_code, strip_tags

    text = F.coalesce(_c(html), F.lit(""))
    low = F.lower(text)
    phrase = "|".join(re.escape(p).replace("\\ ", " ") for p in fixed.BLOCK_PHRASES)
    title_phrase = "|".join(re.escape(p).replace("\\ ", " ") for p in fixed.BLOCK_TITLE_PHRASES)
    body = body_html(text)
    words = F.size(F.filter(F.split(uni_trim(strip_tags(strip_code(body), " ")), r"(?U)\s+"), lambda w: w != ""))
    asks_script = low.contains("enable javascript") | low.contains("turn on javascript")
    return (
        F.when(text == "", False)
        .when(low.rlike(phrase), True)
        .when(low.contains("just a moment") & low.contains("cloudflare"), True)
        .when(F.length(text) < fixed.BLOCK_MIN_LENGTH, False)
        .when(F.lower(page_title(text)).rlike(title_phrase), True)
        .when(asks_script & body.isNotNull() & (words < fixed.BLOCK_MAX_BODY_WORDS), True)
        .otherwise(False)
    )
