"""URL functions: resolution, hosts, paging parameters, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.functions.text import Col, _c, uni_trim

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_BEFORE_QUERY = r"^([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"
_FRAGMENT = r"(#.*)$"


def _group(col: Column, pattern: str) -> Column:
    return F.regexp_extract(col, pattern, 1)


def host(col: Col) -> Column:
    """Authority in lower case, user and port included ('' when the value has none)."""
    return F.lower(F.regexp_extract(_c(col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(walked, "/"), tail)


def absolute_url(base: Col, href: Col) -> Column:
    """C11: resolve ``href`` against ``base``."""
    base, href = _c(base), F.coalesce(_c(href), F.lit(""))
    origin = _group(base, _ORIGIN)
    base_path = F.regexp_replace(_group(base, _BEFORE_QUERY), _ORIGIN, "")
    directory = F.coalesce(F.nullif(F.regexp_extract(base_path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(directory, href))
    rooted_path = _group(rooted, _BEFORE_QUERY)
    resolved = F.when(rooted_path.rlike(r"/\.\.?(?:/|$)"),
                      F.concat(_without_dot_segments(rooted_path), F.substring(rooted, F.length(rooted_path) + 1, F.length(rooted))))\
                .otherwise(rooted)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("?"), F.concat(_group(base, _BEFORE_QUERY), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin, resolved))
    )


def with_site_key(df: DataFrame, sites: DataFrame, *, url: str, site_col: str = "site_key") -> DataFrame:
    """Left-join ``sites(site_key, base_url)`` on exact lower-case host; no match gives null.

    No hint: Spark broadcasts the site list from its own size estimate and shuffles it otherwise.
    """
    keyed = sites.select(host("base_url").alias("__host"), F.col("site_key").alias(site_col)) \
                 .groupBy("__host").agg(F.min(site_col).alias(site_col))
    return df.withColumn("__host", host(url)).join(keyed, "__host", "left").drop("__host")


def is_url_for_site(url: Col, base_url: Col) -> Column:
    """Exact host equality, false for empty input."""
    return F.coalesce((host(url) != "") & (host(url) == host(base_url)), F.lit(False))


def with_page(url: Col, page: Col) -> Column:
    """Put page N into the path segment, path suffix or query; N <= 1 leaves the url alone.

    Other query parameters keep their order and spelling.
    """
    url, page = _c(url), _c(page)
    number = page.cast("string")
    path, query, fragment = _group(url, _BEFORE_QUERY), _group(url, _QUERY), _group(url, _FRAGMENT)
    segment, suffix = r"(?i)/(page|trang|p)/[0-9]+$", r"(?i)-(page|trang|p)-[0-9]+$"
    parameter = r"([?&])(page|paged|pageindex)=[^&]*"
    new_path = (
        F.when(path.rlike(segment), F.regexp_replace(path, F.lit(segment), F.concat(F.lit("/$1/"), number)))
        .when(path.rlike(suffix), F.regexp_replace(path, F.lit(suffix), F.concat(F.lit("-$1-"), number)))
    )
    new_query = (
        F.when(query.rlike(parameter), F.regexp_replace(query, F.lit(parameter), F.concat(F.lit("$1$2="), number)))
        .when(F.length(query) > 1, F.concat(query, F.lit("&page="), number))
        .otherwise(F.concat(F.lit("?page="), number))
    )
    return (
        F.when(page <= 1, url)
        .when(new_path.isNotNull(), F.concat(new_path, query, fragment))
        .otherwise(F.concat(path, new_query, fragment))
    )


def desktop_url(col: Col) -> Column:
    """C14: drop a leading ``m.`` or ``mobile.`` of the host; port, path and query stay."""
    return F.regexp_replace(_c(col), r"^([A-Za-z][A-Za-z0-9+.-]*://)(?i:m|mobile)\.", "$1")


def work_url(col: Col, base: Col, prefix: str = "doc-truyen", listing: str = "tong-hop") -> Column:
    """Absolute url whose path starts with ``/prefix/``; a leading listing segment is dropped."""
    full = absolute_url(base, col)
    origin = _group(full, _ORIGIN)
    path = F.regexp_replace(_group(full, _BEFORE_QUERY), _ORIGIN, "")
    tail = F.substring(full, F.length(_group(full, _BEFORE_QUERY)) + 1, F.length(full))
    rooted = F.concat(F.lit("/"), F.regexp_replace(path, r"^/+", ""))
    alias = F.regexp_replace(F.regexp_replace(rooted, r"/+", "/"), r"^/|/$", "")
    alias = F.regexp_replace(alias, rf"(?i)^{listing}(?:/|$)", "")
    forced = F.when(alias != "", F.concat(F.lit(f"/{prefix}/"), alias)).otherwise(F.lit(f"/{prefix}"))
    kept = F.when(F.lower(rooted).startswith(f"/{prefix}/"), rooted).otherwise(forced)
    return F.when(F.coalesce(_c(col), F.lit("")) == "", _c(col)).otherwise(F.concat(origin, kept, tail))


def clean_base_url(col: Col) -> Column:
    """Trim, strip trailing ``! ? # ' \"`` then ``/`` and space, add ``https://``; empty gives null."""
    trimmed = F.regexp_replace(uni_trim(col), r"""[!?#'"]+$""", "")
    stripped = F.regexp_replace(trimmed, r"[/ \t\n\r]+$", "")
    return F.when(stripped == "", F.lit(None).cast("string")) \
            .when(stripped.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), stripped) \
            .otherwise(F.concat(F.lit("https://"), stripped))
