"""Titles, numbers, names and bodies: scalar text functions as Catalyst expressions.

Regular expressions run on the JVM: ``(?U)`` gives ``\\s``/``\\w`` their Unicode meaning and
``(?iu)`` folds case beyond ASCII. Casts are ``try_cast`` because ANSI mode raises otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from serialake import fixed

Col = Column | str


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, where it is used several times around lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Every character that counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def uni_trim(col: Col) -> Column:
    """Strip any Unicode white space at both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def collapse_space(col: Col) -> Column:
    """White-space runs become one space, ends trimmed, null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " ")), F.lit(""))


def digits_as_int(col: Col) -> Column:
    """Drop every non-digit and parse what is left ("3 of 10" is 310)."""
    return F.regexp_replace(_c(col), r"[^0-9]", "").try_cast("bigint")


def genre_name(col: Col) -> Column:
    """Drop private-use icons, collapse, then strip trailing counts such as ``(2115)``."""
    cleaned = collapse_space(F.regexp_replace(_c(col), r"\p{Co}", ""))
    return uni_trim(F.regexp_replace(cleaned, r"(?:[\s(\[ ]*[0-9]+[\s)\] ]*)+$", ""))


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def fold_accents(col: Col) -> Column:
    """Remove combining marks and map accented letters to their base; other characters stay."""
    table = fixed.decomposable_letters() | fixed.STROKE_LETTERS
    col = _c(col)
    folded = F.regexp_replace(_translate(col, table), r"\p{M}+", "")
    # Plain ASCII has nothing to fold: as many bytes as characters.
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(folded)


def to_ascii(col: Col) -> Column:
    """Latin-script transliteration; letters and digits of other scripts stay, other characters without a mapping vanish."""
    one_to_one = {k: v for k, v in fixed.PLAIN_PUNCTUATION.items() if len(v) == 1}
    many = fixed.DIGRAPH_LETTERS | {k: v for k, v in fixed.PLAIN_PUNCTUATION.items() if len(v) > 1}
    col = _c(col)
    table = fixed.decomposable_letters() | fixed.STROKE_LETTERS | fixed.SPECIAL_LETTERS | one_to_one
    out = _translate(col, table)
    for char, plain in many.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    out = F.regexp_replace(out, r"[^\x00-\x7F\p{L}\p{N}]+", "")
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(out)


def slug(col: Col) -> Column:
    """C4: Latin letters as ASCII, lower case, punctuation removed, white space to ``-``, ends stripped of ``-_``."""
    kept = F.regexp_replace(F.lower(to_ascii(col)), r"[^\p{L}\p{N}_\s-]", "")
    dashed = F.regexp_replace(kept, r"\s+", "-")
    return F.coalesce(F.regexp_replace(dashed, r"^[-_]+|[-_]+$", ""), F.lit(""))


# Words that announce a part number, accents already folded.
_PART_WORD = r"(?:chuong|chapter|chap|ch)"


def _int_group(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col, pattern, group).try_cast("bigint")


def part_number(col: Col) -> Column:
    """Number after a part word anywhere in the title, else a leading number; null if there is none or it exceeds a bigint."""
    folded = fold_accents(col)
    return F.coalesce(
        _int_group(folded, rf"(?i){_PART_WORD}(?U)\s*(?-U)[:\-]?(?U)\s*(?-U)([0-9]+)"),
        _int_group(folded, r"^(?U)\s*(?-U)([0-9]+)[.\-\s ]"),
    )


def strip_part_number(col: Col) -> Column:
    """Remove a leading ``Chapter N:`` or ``N.``; the cut is made on the original characters."""
    original = F.coalesce(_c(col), F.lit(""))
    folded = fold_accents(original)
    worded = F.regexp_extract(folded, rf"(?i)^{_PART_WORD}(?U)\s*(?-U)[0-9]+(?U)\s*(?-U)[:\-.)]?(?U)\s*", 0)
    leading = F.regexp_extract(folded, r"^(?U)\s*(?-U)[0-9]+(?U)\s*(?-U)[:\-.)]?(?U)\s*", 0)
    prefix = F.when(worded != "", worded).otherwise(leading)
    return uni_trim(F.substring(original, F.length(prefix) + F.lit(1), F.length(original)))


def part_file_name(title: Col, number: Col) -> Column:
    """``0003_slug.txt``; an empty slug becomes ``untitled``."""
    name = F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("untitled"))
    return F.format_string("%04d_%s.txt", _c(number).cast("bigint"), name)


def match_key(col: Col) -> Column:
    """Title without number prefix, Latin letters as ASCII, lower case, all but letters and digits collapsed to spaces."""
    plain = F.lower(to_ascii(strip_part_number(col)))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def part_sort_key(url: Col, title: Col) -> Column:
    """(number in url, else number in title, else 0; url) as an orderable struct."""
    url, title = F.coalesce(_c(url), F.lit("")), F.coalesce(_c(title), F.lit(""))
    number = F.coalesce(
        _int_group(url, r"(?i)(?:chuong|chapter)[^0-9]*([0-9]+)"),
        _int_group(title, r"(?iu)(?:ch(?:u|ư)ơng|chapter)(?U)\s*(?-U)([0-9]+)"),
        F.lit(0),
    )
    return F.struct(number.cast("bigint").alias("number"), url.alias("url"))


def label_number(col: Col) -> Column:
    """Number after a part word, else the first integer of the label."""
    return F.coalesce(
        _int_group(_c(col), r"(?i)(?:chuong|chapter)[^0-9]*([0-9]+)"),
        _int_group(_c(col), r"([0-9]+)"),
    )


def safe_file_name(col: Col) -> Column:
    """Characters a file system refuses become ``_``."""
    return F.regexp_replace(_c(col), r"""[\\/*?:"<>|]""", "_")


def category_name(categories: Col, fallback: Col) -> Column:
    """C17: name of the first category, else the discovery genre, else ''."""
    cats = _c(categories)
    return F.when(F.coalesce(F.size(cats), F.lit(0)) > 0,
                  F.coalesce(F.try_element_at(cats, F.lit(1)).getField("name"), F.lit("")))\
            .otherwise(F.coalesce(_c(fallback), F.lit("")))


def content_hash(col: Col) -> Column:
    """SHA-256 of the UTF-8 bytes, hexadecimal."""
    return F.sha2(_c(col), 256)


def title_from_slug(col: Col) -> Column:
    """``-`` and ``_`` to spaces, title case."""
    return F.initcap(F.trim(F.translate(_c(col), "-_", "  ")))


def backoff_seconds(failures: Col, base: int = 5, ceiling: int = 60) -> Column:
    """``min(ceiling, base * 2^failures)``."""
    return F.least(F.lit(float(ceiling)), F.lit(base) * F.pow(F.lit(2), _c(failures))).cast("bigint")


def linear_delay_seconds(delay: Col, attempt: Col) -> Column:
    """``delay * attempt``."""
    return (_c(delay) * _c(attempt)).cast("bigint")


WARNING_LINE = r"(?iu)\[WARNING\].*Sau crawl"
WARNING_BODY = r"(?iu)\[WARNING\].*?truyện '([^']+)' vẫn thiếu chương: ([0-9]+)\+([0-9]+)/\s?([0-9]+)"


def parse_warning(line: Col) -> Column:
    """Title and counts of an incompleteness warning; all null when the line does not match."""
    line = _c(line)
    title = uni_trim(F.nullif(F.regexp_extract(line, WARNING_BODY, 1), F.lit("")))
    return F.struct(
        title.alias("story_title"),
        _int_group(line, WARNING_BODY, 2).alias("crawled_count"),
        _int_group(line, WARNING_BODY, 3).alias("dead_count"),
        _int_group(line, WARNING_BODY, 4).alias("total_count"),
    )


def title_equal_key(col: Col) -> Column:
    """Key under which two titles count as the same (lower case, trimmed)."""
    return F.lower(uni_trim(col))


def stored_body(url: Col, work: Col, category: Col, part: Col, body: Col) -> Column:
    """Header lines, a blank line, then the body."""
    null_safe = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in (url, work, category, part, body)]
    return F.concat(
        F.lit("Nguon: "), null_safe[0], F.lit("\n\nTruyen: "), null_safe[1],
        F.lit("\nThe loai: "), null_safe[2], F.lit("\nChuong: "), null_safe[3],
        F.lit("\n\n"), null_safe[4],
    )


def percent(done: Col, total: Col) -> Column:
    """Done / total in percent; 0 when the total is not positive."""
    return F.when(_c(total) > 0, _c(done) * F.lit(100.0) / _c(total)).otherwise(F.lit(0.0))


def chunks(col: Col, size: int = 4000) -> Column:
    """Consecutive pieces of at most ``size`` characters (array; explode with ``posexplode``)."""
    text = F.coalesce(_c(col), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), lambda p: p != "")


# The entities the regular-expression text path understands. `&amp;` goes last.
NAMED_ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&#x27;": "'",
    "&apos;": "'",
    "&amp;": "&",
}


def unescape(col: Col) -> Column:
    """Decode the common entities."""
    out = _c(col)
    for entity, char in NAMED_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape(col: Col) -> Column:
    """Encode ``& < > \" '``."""
    out = _c(col)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out
