"""B: page extraction on the ``pages`` table."""

from __future__ import annotations

import base64
import html as html_lib
import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from serialake import rules
from serialake.catalog.registry import Catalog
from serialake.catalog.scalars import COLLAPSE, D1_SQL, NAV_SQL, PAGE_TITLE, RULES, UNESCAPE
from serialake.functions import markup, payload, text, urls
from serialake.operators import chains, extract, nodes, plugins
from serialake.plans import cleaning
from serialake.rules import Rule

catalog = Catalog()
q = catalog.query

STRIP = r"regexp_replace({0}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
ARTICLE = "regexp_extract(" + STRIP.format("html") + r", '(?is)<article[^>]*>(.*?)</article\s*>', 1)"
TO_TEXT = (r"regexp_replace(regexp_replace(regexp_replace(replace(" +
           UNESCAPE.format(r"regexp_replace(regexp_replace({0}, '(?i)<br\s*/?>', chr(10) || chr(10) || chr(10), 'g'), '(?:<[^>]*>)+', chr(10), 'g')") +
           r", chr(160), ' '), '[^\S\n]*\n[^\S\n]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
BLOCKS = "regexp_replace(" + TO_TEXT + r", '\n{{2,}}', chr(10), 'g')"
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"

NAV_LINKS = [Rule("link", "header a[href^='/missing/']"), Rule("link", "nav li a[href]", 1), Rule("link", "a[href]", 2)]
# Anchors in page order with their text.
LINKS_SQL = rf"""(select page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) as href,
    unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) as name,
    unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)))) as pos from pages)"""


@q("b1_link_inventory", rf"""select page_id, cast(pos as bigint) as pos, name, {ORIGIN} || href as url from (
    select *, row_number() over (partition by page_id, lower(href) order by pos) as rn from {LINKS_SQL}) where rn = 1""")
def _(t):
    return extract.link_inventory(t.pages, NAV_LINKS).withColumn("pos", F.col("pos").cast("bigint"))


@q("b2_listing_link", rf"""select page_id, score, url from (select page_id, score, target as url, row_number() over (partition by page_id order by score desc, target desc) as rn
    from (select page_id, {ORIGIN} || href as target, cast((case when href like '%th%' then 3 else 0 end) + (case when name like '%e%' then 2 else 0 end)
      - (case when href like '%i%' or href like '%o%' then 1 else 0 end) as bigint) as score from {LINKS_SQL} where href like '%e%')) where rn = 1""")
def _(t):
    return extract.listing_link(t.pages, required=["e"], weights=[("href", "th", 3), ("text", "e", 2), ("href", "i|o", -1)])


@q("b3_listing_rows", rf"""select page_id, name as title, {ORIGIN} || href as url, null::varchar as latest_part, null::varchar as author from (
    select *, row_number() over (partition by page_id, href order by pos) as rn from {LINKS_SQL}) where rn = 1""")
def _(t):
    # Each page's navigation entries play the work rows.
    found = rules.listing_rules(["nav ul li"], ["a.name[href]", "a[href]"], ["a[href]"], ["span.author"])
    return extract.listing_rows(t.pages, found).select("page_id", "title", "url", "latest_part", "author")


def card_pages(customer):
    """Listing pages with three cards, the last one a repeat; every third page in the layout that marks works by item type."""
    def card(shift: int):
        key = (F.col("c_custkey") + shift).cast("string")
        catalog = ["<div class='book-wrap'><h3><a class='name' href='/doc-truyen/", key, "'>Work ", key, "</a></h3><p><a class='section' href='/doc-truyen/", key, "/chuong-", F.col("c_nationkey").cast("string"), "'>Part ",
                   F.col("c_nationkey").cast("string"), "</a></p><p class='author'><a class='writer' href='/t/", key, "'>", F.col("c_mktsegment"), "</a></p></div>"]
        typed = ["<section itemscope itemtype='https://schema.org/Book'><b itemprop='name'><a href='/w/", key, "'> Work ", key, " </a></b><i itemprop='author'>", F.col("c_mktsegment"), "</i></section>"]
        joined = [F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]) for parts in (catalog, typed)]
        return F.when(F.col("c_custkey") % 3 == 0, joined[1]).otherwise(joined[0])

    html = F.concat(F.lit("<body><div class='update-list'>"), card(0), card(7), card(0), F.lit("</div></body>"))
    return customer.select(F.col("c_custkey").alias("page_id"), F.lit("https://l.example/list").alias("url"), html.alias("html"))


_CARDS = "(select *, unnest([c_custkey, c_custkey + 7]) as k from customer)"


@q("b3_card_listing", f"""select c_custkey as page_id, 'Work ' || k as title, 'https://l.example/doc-truyen/' || k as url, 'Part ' || c_nationkey as latest_part,
    'https://l.example/doc-truyen/' || k || '/chuong-' || c_nationkey as latest_part_url, c_mktsegment as author from {_CARDS} where c_custkey % 3 <> 0""")
def _(t):
    return extract.listing_rows(card_pages(t.spread("customer", "c_custkey")).where("page_id % 3 <> 0"), rules.CATALOG_LISTING).drop("pos")


@q("b3_schema_listing", f"select c_custkey as page_id, 'Work ' || k as title, 'https://l.example/w/' || k as url, c_mktsegment as author from {_CARDS} where c_custkey % 3 = 0")
def _(t):
    return extract.listing_rows(card_pages(t.spread("customer", "c_custkey")), rules.SCHEMA_LISTING).select("page_id", "title", "url", "author")


@q("b13_page_identifiers", """select c_custkey as page_id, 'n' || c_custkey as nonce, case c_custkey % 3 when 0 then cast(c_custkey as varchar) when 1 then 'r' || c_custkey else 'p' || c_custkey end as work_id from customer""")
def _(t):
    key, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    work = F.when(kind == 0, F.concat(F.lit('<script>{"manga_id": "'), key, F.lit('"}</script>'))).when(kind == 1, F.concat(F.lit('<input class="x rating-post-id" type="hidden" value="r'), key, F.lit('">'))).otherwise(F.lit(""))
    nonce = F.when(kind == 0, F.concat(F.lit('<i data-nonce="n'), key, F.lit('"></i><script>{"security": "wrong"}</script>'))).otherwise(F.concat(F.lit('<script>{"ajax_nonce" : "n'), key, F.lit('"}</script>')))
    html = F.concat(F.lit('<body class="single postid-p'), key, F.lit('">'), work, nonce)
    return t.customer.select(F.col("c_custkey").alias("page_id"), markup.first_of(html, markup.NONCE_PATTERNS).alias("nonce"), markup.first_of(html, markup.WORK_ID_PATTERNS).alias("work_id"))


@q("b14_class_counters", """select c_custkey as page_id, name, n from customer, lateral (select unnest(['likes', 'views']) as name, unnest([c_custkey * 1000, c_nationkey]) as n) where name = 'likes' or c_custkey % 2 = 0""")
def _(t):
    key = F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<span class='num a-like'>"), key, F.lit(".000 likes</span><span class='a-liked'>7</span>"),
                    F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<span class=a-view>"), F.col("c_nationkey").cast("string"), F.lit("</span>"))).otherwise(F.lit("<span class='a-view'>none</span>")))
    counted = t.customer.select(F.col("c_custkey").alias("page_id"), markup.class_counters(html, {"a-like": "likes", "a-view": "views", "a-other": "other"}).alias("m"))
    return counted.select("page_id", F.explode("m").alias("name", "n"))


@q("b4_page_count", r"""select page_id, greatest(1, page_id % 11, page_id % 17, page_id % 13,
    coalesce(list_max(list_transform(regexp_extract_all(html || 'href="' || url, 'href="[^"]*?\bpage=([0-9]+)', 1), lambda x: cast(x as bigint))), 1)) as page_count from pages""")
def _(t):
    # Each page gets a select, a pagination list and data-page marks of its own, and larger numbers in places that do not count.
    def number(base: int, divisor: int):
        return (F.col("page_id") % divisor + base).cast("string")

    html = F.concat(
        "html", F.lit('<p><a href="/archive">'), number(2000, 30), F.lit('</a><option value="'), number(3000, 9), F.lit('">x</option><i data-page="'), number(4000, 5), F.lit('x"></i></p>'),
        F.lit('<select name="p"><option value="'), number(0, 11), F.lit('" selected>x</option></select>'),
        F.lit('<ul class="list pagination"><li><a class="page-link" href="'), "url", F.lit('"> '), number(0, 17), F.lit(' </a></li></ul><i data-page="'), number(0, 13), F.lit('"></i>'))
    return t.pages.select("page_id", markup.page_count(html).alias("page_count"))


PAGE_DETAIL = [Rule("title", "article h1"), Rule("title", "title", 1), Rule("description", "article p"), Rule("category", "nav li a[href]")]


@q("b5_work_detail", rf"""select page_id, {COLLAPSE.format(UNESCAPE.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')"))} as title,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, cast((select count(distinct lower(x.h)) from (select unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) as h) x) as bigint) as categories from pages""")
def _(t):
    detail = extract.work_detail(t.pages, PAGE_DETAIL)
    lang = t.pages.select("page_id", markup.page_language("html").alias("lang"))
    return detail.select("page_id", "title", F.size("categories").cast("bigint").alias("categories")).join(lang, "page_id")


def reader_pages(customer):
    """Detail pages of the second layout; totals come from an attribute, from ranges or from the part links."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kind = F.col("c_custkey") % 3
    parts = F.when(kind == 0, F.concat(F.lit('<ul class="main version-chap" data-last="chuong-'), key, F.lit('"></ul>'))) \
        .when(kind == 1, F.concat(F.lit('<ul class="main version-chap"><li class="has-child" data-value="1-9"><a class="has-child">Chương 10 - 1</a></li><li class="has-child" data-value="11-'), key,
                                  F.lit('1"><a class="has-child">new</a></li></ul>'))) \
        .otherwise(F.lit('<ul class="version-chap"><li><a href="/c/1">a</a></li><li><a href="/c/2">b</a></li><li><a href="/c/1">a</a></li></ul>'))

    def item(heading: str, value) -> list:
        return [F.lit(f'<div class="post-content_item"><div class="summary-heading"><h3> {heading} </h3></div><div class="summary-content"><div>'), value, F.lit("</div></div></div>")]

    html = F.concat(F.lit('<html><head><script type="application/ld+json">{"aggregateRating": {"ratingValue": "'), nation, F.lit('", "reviewCount": '), key,
                    F.lit('}}</script></head><body class="single postid-'), key, F.lit('"><div class="post-title"><h1>  '), "c_name", F.lit(" </h1></div>"),
                    *item("Loại", F.lit("other")), *item("Trạng thái", F.col("c_mktsegment")), F.lit('<div class="author-content"><a>Author '), nation,
                    F.lit('</a></div><div class="description-summary"><div class="summary__content"><p>About '), key, F.lit('</p><script>no</script><p>and more</p></div></div><div class="genres-content"><a href="/g/'),
                    nation, F.lit('">G'), nation, F.lit('</a> <a href="/g/all">All</a></div><div class="summary_image"><img src="/img/'), key, F.lit('.jpg"></div>'), parts, F.lit("</body></html>"))
    return customer.select(F.col("c_custkey").alias("page_id"), F.lit("https://r.example/work").alias("url"), html.alias("html"))


@q("b5_reader_detail", """select c_custkey as page_id, c_name as title, 'Author ' || c_nationkey as author, c_mktsegment as status, 'About ' || c_custkey || chr(10) || 'and more' as description,
    'https://r.example/img/' || c_custkey || '.jpg' as cover, 'G' || c_nationkey || '=https://r.example/g/' || c_nationkey || ',All=https://r.example/g/all' as categories, '' as tags,
    case c_custkey % 3 when 0 then c_custkey when 1 then greatest(10, 11, c_custkey * 10 + 1) else 2 end as total_parts, cast(c_custkey as varchar) as work_id, null::varchar as work_path,
    cast(c_nationkey as varchar) as rating_value, nullif(cast(c_custkey as varchar), '0') as rating_count, '{}' as stats, 'reader' as source from customer""")
def _(t):
    detail = extract.work_detail(reader_pages(t.spread("customer", "c_custkey")), rules.READER_DETAIL, status_heading=rules.READER_STATUS_HEADING, description_separator="\n", source=F.lit("reader"))
    pairs = F.transform("categories", lambda c: F.concat(c["name"], F.lit("="), c["url"]))
    return detail.withColumns({"categories": F.array_join(pairs, ","), "tags": F.array_join("tags", ","), "stats": F.to_json("stats")})


@q("b12_page_ranges", """select c_custkey as page_id, 0 as pos, 1::bigint as "from", 10::bigint as "to" from customer where c_custkey % 3 = 1 union all
    select c_custkey, 1, least(11, c_custkey * 10 + 1), greatest(11, c_custkey * 10 + 1) from customer where c_custkey % 3 = 1""")
def _(t):
    return extract.page_ranges(reader_pages(t.spread("customer", "c_custkey")), rules.READER_RANGES)


@q("b6_part_list", rf"""select page_id, title, url from (select page_id, name as title, {ORIGIN} || href as url,
    row_number() over (partition by page_id, href order by pos) as rn from {LINKS_SQL}) where rn = 1""")
def _(t):
    return extract.part_list(t.pages, rules.CATALOG_PARTS).select("page_id", "title", "url")


@q("b6_part_list_newest_first", rf"""select page_id, url, row_number() over (partition by page_id order by k) - 1 as place from (
    select page_id, {ORIGIN} || href as url, min(-pos) as k from {LINKS_SQL} group by all)""")
def _(t):
    # No numbers in these titles, so the list counts as newest-first and is turned around.
    parts = extract.part_list(t.pages, rules.CATALOG_PARTS, detect_newest_first=True)
    from serialake.operators.running import position
    return position(parts.select("page_id", "pos", "url"), key=["page_id"], order=["pos"], name="place").select("page_id", "url", "place")


@q("b7_main_content", f"""select page_id, {TO_TEXT.format(ARTICLE)} as text from pages""")
def _(t):
    return t.pages.select("page_id", markup.fragment_to_text(markup.container(markup.strip_code("html"))).alias("text"))


@q("b7_main_content_by_rules", f"""select page_id, {BLOCKS.format(ARTICLE)} as text from pages""")
def _(t):
    found = extract.main_content(t.pages, [Rule("content", "div.chapter-c-content"), Rule("content", "article", 1)], rules.CATALOG_CONTENT_NOISE)
    return found.select("page_id", F.coalesce("text", F.lit("")).alias("text"))


@arrow_udf(T.StringType())
def _deflate(values: pa.Array) -> pa.Array:
    made = [pa.array([base64.b64encode(zlib.compress(v.encode())).decode() for v in some.to_pylist()], pa.string()) for some in nodes.slices(values)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@q("b8_embedded_payload", "select doc_id, text as payload from documents")
def _(t):
    script = F.concat(F.lit("var base64 = '!!'; var page = {\"base64\": \""), _deflate("text"), F.lit("\"}; pako.inflate(page);"))
    return t.documents.select("doc_id", payload.embedded_payload(script).alias("payload"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PARAGRAPHS = f"'<p>' || replace({_ESCAPED}, chr(10), '</p><p>') || '</p>'"


def payload_pages(documents):
    """Part pages that carry their text in the named script, in its attribute, in another script, or in the container."""
    body = F.expr(_PARAGRAPHS)
    noise = F.lit("<div class='ads'>Buy <div>now</div></div><div><p>listen</p><a href='/hdsd/xaudio.php'>audio</a></div><script>x</script>")
    packed = _deflate(F.concat(body, noise))
    kind = F.col("doc_id") % 4
    shell = F.when(kind == 0, F.concat(F.lit("<script>var x = 1;</script><script id='decompress-script'>var base64 = '"), packed, F.lit("';</script>"))) \
        .when(kind == 1, F.concat(F.lit("<script id='decompress-script' data-base64='"), packed, F.lit("'></script>"))) \
        .when(kind == 2, F.concat(F.lit("<script id='decompress-script'>base64 = 'none'</script><script>page = {\"base64\": \""), packed, F.lit("\"}; pako.inflate(page)</script>"))) \
        .otherwise(F.concat(F.lit("<div id='chapter-reading-content'><script>y</script>"), body, F.lit("</div>")))
    return documents.select("doc_id", F.concat(F.lit("<html><body><h2> Part "), F.col("doc_id").cast("string"), F.lit(" </h2>"), shell, F.lit("</body></html>")).alias("html"))


@q("b8_payload_pages", f"""select doc_id, 'Part ' || doc_id as title, case when doc_id % 4 = 3 then 'container' else 'payload' end as source, {BLOCKS.format(_PARAGRAPHS)} as text from documents""")
def _(t):
    return extract.reader_content(payload_pages(t.documents), rules.READER_CONTENT, page_id="doc_id").select("doc_id", "title", "source", "text")


@q("b9_fragment_to_text", f"select page_id, {TO_TEXT.format(STRIP.format('html'))} as text from pages")
def _(t):
    return t.pages.select("page_id", markup.fragment_to_text(markup.strip_code("html")).alias("text"))


@q("b10_strip_noise", rf"""select page_id, regexp_replace({STRIP.format('html')}, '(?is)<div class="ad">[^<]*</div>', '', 'g') as html from pages""")
def _(t):
    return t.pages.select("page_id", markup.strip_flat_blocks(markup.strip_code("html"), ["ad"]).alias("html"))


@q("b10_strip_noise_by_tree", rf"""select page_id, regexp_replace(regexp_replace({STRIP.format('html')}, '(?is)<div class="ad">[^<]*</div>', '', 'g'), '(?i)^<!doctype html>', '') as html from pages""")
def _(t):
    return t.pages.select("page_id", payload.remove_noise(F.col("html"), ("ad",)).alias("html"))


@q("b11_rating", """select event_id, cast(value as varchar) as rating_value, json_extract_string(props, '$.k') as rating_count from events""")
def _(t):
    ld = F.concat(F.lit('<script type="application/ld+json">{"aggregateRating": {"ratingValue": "'), F.col("value").cast("string"),
                  F.lit('", "ratingCount": '), F.get_json_object("props", "$.k"), F.lit("}}</script>"))
    e = t.events.select("event_id", markup.rating(markup.json_ld(ld)).alias("r"))
    return e.select("event_id", "r.rating_value", "r.rating_count")


@q("b12_part_ranges", """select l_orderkey, l_partkey, least(l_partkey, l_suppkey) as "from", greatest(l_partkey, l_suppkey) as "to", l_linenumber, l_shipdate from lineitem""")
def _(t):
    label = F.concat(F.lit("Parts "), "l_partkey", F.lit(" - "), "l_suppkey")
    labels = F.array(label, label, F.lit("no digits"))
    ranges = extract.part_ranges(t.lineitem, labels=labels, keep=["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"])
    return ranges.drop("pos")


@q("b13_identifier", r"""select page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)\.html', 1), ''), nullif(regexp_extract(url, '/([0-9]+)/?$', 1), ''),
    nullif(regexp_extract(url, '/([0-9]+)', 1), '')) as work_id from pages""")
def _(t):
    return t.pages.select("page_id", markup.first_of("url", [r"/([0-9]+)\.html", r"/([0-9]+)/?$", r"/([0-9]+)"]).alias("work_id"))


@q("b14_counters", r"""select * from (select page_id, tag, cast(len(regexp_extract_all(html, '(?i)<' || tag || '\b')) as bigint) as n
    from pages, (select unnest(['p', 'a', 'h1', 'table', 'b']) as tag)) where n > 0""")
def _(t):
    counted = t.pages.select("page_id", markup.tag_counters("html", ["p", "a", "h1", "table", "b"]).alias("m"))
    return counted.select("page_id", F.explode("m").alias("tag", "n"))


# One profile per host, derived from the pages themselves; a host's age is its smallest page id in hours.
def profiles(t):
    hosts = t.pages.groupBy(urls.host("url").alias("domain")).agg(F.min("page_id").alias("age"))
    none = F.lit(None).cast("string")
    return hosts.select("domain", (F.lit(1_000_000) - F.col("age") * 3600).alias("detected_at"), F.lit(100).alias("ttl_hours"),
                        F.lit("nav li").alias("item_selector"), F.lit("a[href]").alias("link_selector"), none.alias("title_selector"),
                        none.alias("author_selector"), F.lit("?p={n}").alias("next_pattern"), none.alias("next_selector"), F.lit("article").alias("content_selector"))


PROFILE_SQL = f"""(select domain from (select {HOST} as domain, min(page_id) as age from pages group by 1) where age <= 100)"""


@q("b15_live_profiles", rf"""select page_id, p.domain, rtrim(url, '/') || case when url like '%?%' then '&' else '?' end || 'p=2' as next_url
    from pages join {PROFILE_SQL} p on {HOST} = p.domain""")
def _(t):
    live = extract.live_profiles(t.pages, profiles(t), now=F.lit(1_000_000))
    return live.select("page_id", "domain", extract.next_page_url(F.col("url"), F.col("next_pattern"), F.lit(None).cast("string")).alias("next_url"))


@q("b15_profile_listing", rf"""select page_id, name as title, href as url from {LINKS_SQL} join {PROFILE_SQL} p on {HOST} = p.domain""")
def _(t):
    live = extract.live_profiles(t.pages, profiles(t), now=F.lit(1_000_000))
    return extract.profile_listing(live, rules=rules.profile_rules()).select("page_id", "title", "url")


@q("b15_profile_content", f"""select page_id, nullif({BLOCKS.format(ARTICLE)}, '') as text from pages join {PROFILE_SQL} p on {HOST} = p.domain""")
def _(t):
    live = extract.live_profiles(t.pages, profiles(t), now=F.lit(1_000_000))
    return extract.profile_content(live).select("page_id", "text")


def listing_pages(pages):
    """Seven pages a listing: even ones link their next page (every sixth in a circle), odd ones count by a pattern; some have a gap."""
    number, k = F.expr("page_id div 7"), F.col("page_id") % 7
    url = lambda at: F.concat(F.lit("https://l.example/list"), number.cast("string"), F.when(at > 0, F.concat(F.lit("?p="), (at + 1).cast("string"))).otherwise(F.lit("")))
    following = F.when(k < 6, url(k + 1)).when(number % 6 == 0, url(F.lit(0)))
    html = F.concat(F.lit("<body><a href='/x'>x</a>"), F.coalesce(F.concat(F.lit("<div class='pager'><a class='next' href='"), following, F.lit("'>next</a></div>")), F.lit("")), F.col("html"))
    odd = number % 2 == 1
    return pages.where(~((k == 3) & (number % 5 == 1) & (number % 6 != 0))).select(
        "page_id", url(k).alias("url"), html.alias("html"), F.when(odd, F.lit("?p={n}")).alias("next_pattern"), F.when(~odd, F.lit(".pager a.next")).alias("next_selector"))


_CHAIN_SQL = """(select page_id, page_id // 7 as n, page_id % 7 as k, case when page_id % 7 > 3 and (page_id // 7) % 5 = 1 and (page_id // 7) % 6 <> 0 then 4 else 0 end as head,
    (page_id // 7) % 6 = 0 and count(*) over (partition by page_id // 7) = 7 as cyclic from pages where not (page_id % 7 = 3 and (page_id // 7) % 5 = 1 and (page_id // 7) % 6 <> 0))"""
_LIST_URL = "'https://l.example/list' || n || case when {0} > 0 then '?p=' || ({0} + 1) else '' end"


@q("b15_ranked_pages", f"""select page_id, {_LIST_URL.format('k')} as url, {_LIST_URL.format('head')} as listing, (k - head)::bigint as place, cyclic from {_CHAIN_SQL}""")
def _(t):
    return chains.ranked_pages(chains.next_urls(listing_pages(t.pages))).drop("next_url")


@q("b15_listings", f"""select {_LIST_URL.format('head')} as listing, count(*) as pages, bool_or(cyclic) as cyclic, max(k) = 6 and n % 2 = 0 and not bool_or(cyclic) and n % 6 <> 0 as complete,
    case when not bool_or(cyclic) and (max(k) < 6 or n % 2 = 1) then 'https://l.example/list' || n || '?p=' || (max(k) + 2) end as open_url from {_CHAIN_SQL} group by n, head""")
def _(t):
    return chains.listings(chains.ranked_pages(chains.next_urls(listing_pages(t.pages))))


CLEANED_SQL = f"""(select page_id, {HOST} as host, coalesce({D1_SQL.format(BLOCKS.format(ARTICLE))}, '') as text from pages)"""


@q("b16_cleaned_pages", f"select page_id, host, false as blocked, text from {CLEANED_SQL}")
def _(t):
    return cleaning.clean_pages(t.pages, patterns=RULES).drop("has_container")


@q("b16_cleaned_pages_by_rules", f"select page_id, host, false as blocked, text from {CLEANED_SQL}")
def _(t):
    return cleaning.clean_pages_by_rules(t.pages, [Rule("content", "article")], patterns=RULES, noise=("script", "style")).drop("has_container")


@q("b16_cleaned_hosts", f"""select host, count(*) as pages, cast(sum(length(text)) as bigint) as chars, 0::bigint as blocked_pages from {CLEANED_SQL} group by 1""")
def _(t):
    return cleaning.summarise_hosts(cleaning.clean_pages(t.pages, patterns=RULES))


@q("b17_decode", "select page_id, html from pages")
def _(t):
    return t.pages.select("page_id", markup.decode_utf8(F.encode("html", "UTF-8")).alias("html"))


@q("b18_trim_to_bytes", r"""select page_id, left(body, n) as html, strlen(left(body, n))::bigint as bytes from (
    select page_id, body, list_max(list_filter(range(0, 2001), lambda i: strlen(left(body, i)) <= 2000)) as n from (
      select page_id, regexp_extract(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>', '', 'g'), '(?is)(<body\b.*?(?:</body\s*>|$))', 1) as body from pages))""")
def _(t):
    return t.pages.select("page_id", markup.trim_to_bytes("html", 2000).alias("html")).select("page_id", "html", F.octet_length("html").cast("bigint").alias("bytes"))


@q("b19_latest_parts", rf"""select page_id, name as title, {ORIGIN} || href as url from {LINKS_SQL}""")
def _(t):
    found = [Rule("heading", "article h1", 0, "body"), Rule("part", "nav li a[href]", 0, "body")]
    return extract.latest_parts(t.pages, found, phrase="").select("page_id", "title", "url")


@q("d17_quarantine", rf"""select page_id, case when text = '' then 'empty_after_cleaning' end as reason from {CLEANED_SQL} where text = ''
    union all select page_id, 'no_container' as reason from pages""")
def _(t):
    # The same pages once as they are and once without their container.
    bare = t.pages.withColumn("html", F.regexp_replace("html", "(?i)</?article>", ""))
    kept, aside = cleaning.quarantine(cleaning.clean_pages(t.pages.unionByName(bare), patterns=RULES))
    return aside.select("page_id", "reason")


@q("k1_site_rules", rf"""select page_id, name as title, {ORIGIN} || href as url from {LINKS_SQL} where {HOST} like '%.com'""")
def _(t):
    # Two registered site families, chosen by host; pages of other hosts have no rules and yield nothing.
    sites = rules.Sites()
    sites.register("com", "https://example.com", page_size=75, parts=[Rule("part", "nav li a[href]")])
    sites.register("org", "https://example.org", parts=[])
    keyed = t.pages.withColumn("site_key", F.substring_index(urls.host("url"), ".", -1))
    site_rules = F.coalesce(sites.rules_by_site("parts")[F.col("site_key")], F.array().cast(f"array<{rules.RULE_TYPE}>"))
    found = keyed.select("page_id", "url", F.explode(nodes.find_elements_by_row(F.col("html"), site_rules)).alias("e"))
    return found.select("page_id", text.collapse_space("e.text").alias("title"), urls.absolute_url("url", "e.href").alias("url"))


def _titles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Extractor with code of its own: the title element by a pattern."""
    found = [re.search(r"(?is)<title[^>]*>(.*?)</title>", page or "") for page in batch.column("html").to_pylist()]
    rows = [(page, "title", 0, " ".join(html_lib.unescape(m[1]).split())) for page, m in zip(batch.column("page_id").to_pylist(), found) if m]
    ids, fields, places, texts = zip(*rows) if rows else ((),) * 4
    # Another order and types than agreed, and no link.
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.nulls(len(ids), pa.string()), pa.array(fields, pa.string()), pa.array(places, pa.int64()), pa.array(ids, pa.int64())],
                                      ["text", "href", "field", "pos", "page_id"])


@q("k1_site_extractors", rf"""select page_id, 'part' as field, name as text, href from {LINKS_SQL} where {HOST} like '%.com'
    union all select page_id, 'title', {PAGE_TITLE}, null from pages where {HOST} like '%.net'""")
def _(t):
    keyed = t.pages.withColumn("site_key", F.substring_index(urls.host("url"), ".", -1))
    sites = {"com": plugins.rule_extractor([Rule("part", "nav li a[href]")]), "net": _titles}
    found = plugins.extract_by_site(keyed, sites, "page_id bigint, field string, pos int, text string, href string", columns=["page_id", "html"])
    return found.select("page_id", "field", text.collapse_space("text").alias("text"), "href")
