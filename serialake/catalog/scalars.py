"""C: scalar functions; D1 and D3: line functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake import fixed
from serialake.catalog.registry import Catalog, Tables
from serialake.functions import lines, markup, text, urls

catalog = Catalog()
q = catalog.query

# --- SQL snippets shared by the twins -------------------------------------------------------
FOLD = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"
ASCII = r"regexp_replace(replace(replace(" + FOLD + r", 'ß', 'ss'), chr(160), ' '), '[^\x00-\x7F\pL\pN]', '', 'g')"
SLUG = (r"regexp_replace(regexp_replace(regexp_replace(lower(" + ASCII + r"), '[^\pL\pN_\s-]', '', 'g'), "
        r"'\s+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')")
TITLE_TAG = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
UNESCAPE = ("replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&lt;', '<'), "
            "'&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&apos;', chr(39)), '&amp;', '&')")
COLLAPSE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"
PAGE_TITLE = COLLAPSE.format(UNESCAPE.format(TITLE_TAG))
FIRST_LINE = "split_part(text, chr(10), 1)"
# Titles in the shapes the number functions know, one shape per language.
TITLES_SQL = f"""(select doc_id, case lang
    when 'en' then 'Chapter ' || doc_id || ': ' || {FIRST_LINE}
    when 'fr' then doc_id || '. ' || {FIRST_LINE}
    when 'de' then 'Chương ' || doc_id || ' - ' || {FIRST_LINE}
    else {FIRST_LINE} end as title from documents)"""
PART_NUMBER = (
    r"coalesce(try_cast(nullif(regexp_extract(" + FOLD + r", '(?i)(?:chuong|chapter|chap|ch)\s*[:\-]?\s*([0-9]+)', 1), '') as bigint), "
    r"try_cast(nullif(regexp_extract(" + FOLD + r", '^\s*([0-9]+)[.\-\s]', 1), '') as bigint))")
STRIP_PREFIX = (
    r"trim(substr({0}, length(coalesce(nullif(regexp_extract(" + FOLD + r", '(?i)^(?:chuong|chapter|chap|ch)\s*[0-9]+\s*[:\-.)]?\s*'), ''), "
    r"regexp_extract(" + FOLD + r", '^\s*[0-9]+\s*[:\-.)]?\s*'))) + 1))")
MATCH_KEY = r"trim(regexp_replace(lower(" + ASCII.format(STRIP_PREFIX) + r"), '[^\pL\pN]+', ' ', 'g'))"


def titles(t: Tables) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    number = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("Chapter "), number, F.lit(": "), first))
                              .when(F.col("lang") == "fr", F.concat(number, F.lit(". "), first))
                              .when(F.col("lang") == "de", F.concat(F.lit("Chương "), number, F.lit(" - "), first))
                              .otherwise(first).alias("title"))


@q("c1_collapse_space", f"select doc_id, {COLLAPSE.format('text')} as clean from documents")
def _(t):
    return t.documents.select("doc_id", text.collapse_space("text").alias("clean"))


@q("c2_digits_as_int", "select page_id, try_cast(regexp_replace(url, '[^0-9]', '', 'g') as bigint) as n from pages")
def _(t):
    return t.pages.select("page_id", text.digits_as_int("url").alias("n"))


@q("c3_genre_name", "select p_partkey, trim(regexp_replace(replace(p_name, ' ', '  '), '\\s+', ' ', 'g')) as name from part")
def _(t):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ("), F.col("p_size"), F.lit(")  "), F.col("p_partkey"))
    return t.part.select("p_partkey", text.genre_name(raw).alias("name"))


@q("c4_slug", f"select page_id, {SLUG.format(PAGE_TITLE)} as slug from pages")
def _(t):
    return t.pages.select("page_id", text.slug(markup.page_title("html")).alias("slug"))


@q("c5_part_number", f"select doc_id, {PART_NUMBER.format('title')} as n from {TITLES_SQL}")
def _(t):
    return titles(t).select("doc_id", text.part_number("title").alias("n"))


@q("c5b_to_ascii", f"select doc_id, {ASCII.format('text')} as plain from documents")
def _(t):
    return t.documents.select("doc_id", text.to_ascii("text").alias("plain"))


@q("c6_strip_part_number", f"select doc_id, {STRIP_PREFIX.format('title')} as title from {TITLES_SQL}")
def _(t):
    return titles(t).select("doc_id", text.strip_part_number("title").alias("title"))


@q("c7_part_file_name", f"""select conv_id, turn, printf('%04d', turn + 1) || '_' ||
    coalesce(nullif({SLUG.format(FIRST_LINE)}, ''), 'untitled') || '.txt' as file from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.part_file_name(F.substring_index("text", "\n", 1), F.col("turn") + 1).alias("file"))


@q("c8_match_key", f"select doc_id, {MATCH_KEY.format('title')} as key from {TITLES_SQL}")
def _(t):
    return titles(t).select("doc_id", text.match_key("title").alias("key"))


OTHER_SCRIPTS = ("aeionst", "αειоν中文")  # titles of other scripts, made from the given ones
SCRIPT_TITLE = f"translate({FIRST_LINE}, '{OTHER_SCRIPTS[0]}', '{OTHER_SCRIPTS[1]}')"


@q("c8_titles_of_other_scripts", f"""select doc_id, {SLUG.format('title')} as slug, {MATCH_KEY.format('title')} as key,
    printf('%04d', doc_id) || '_' || coalesce(nullif({SLUG.format('title')}, ''), 'untitled') || '.txt' as file from (select doc_id, {SCRIPT_TITLE} as title from documents)""")
def _(t):
    title = F.translate(F.substring_index("text", "\n", 1), *OTHER_SCRIPTS)
    return t.documents.select("doc_id", text.slug(title).alias("slug"), text.match_key(title).alias("key"), text.part_file_name(title, F.col("doc_id")).alias("file"))


@q("c9_part_sort_key", f"""select page_id, coalesce(try_cast(nullif(regexp_extract(link, '(?i)(?:chuong|chapter)[^0-9]*([0-9]+)', 1), '') as bigint),
        try_cast(nullif(regexp_extract(title, '(?i)(?:ch(?:u|ư)ơng|chapter)\\s*([0-9]+)', 1), '') as bigint), 0) as number, link as url
    from (select page_id, {PAGE_TITLE} as title, replace(url, '/en/', '/chapter-') as link from pages)""")
def _(t):
    links = t.pages.select("page_id", markup.page_title("html").alias("title"), F.replace("url", F.lit("/en/"), F.lit("/chapter-")).alias("link"))
    return links.select("page_id", text.part_sort_key("link", "title").alias("k")).select("page_id", "k.number", "k.url")


@q("c9b_label_number", r"""select page_id, coalesce(
    try_cast(nullif(regexp_extract(url, '(?i)(?:chuong|chapter)[^0-9]*([0-9]+)', 1), '') as bigint),
    try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') as bigint)) as n from pages""")
def _(t):
    return t.pages.select("page_id", text.label_number("url").alias("n"))


@q("c10_safe_file_name", r"""select page_id, regexp_replace(url, '[\\/*?:"<>|]', '_', 'g') as name from pages""")
def _(t):
    return t.pages.select("page_id", text.safe_file_name("url").alias("name"))


# Links of the navigation block, resolved against the page url.
NAV_SQL = r"""(select page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) as href from pages)"""


@q("c11_absolute_url", rf"""select page_id, url, href,
    case when href like '/%' then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href else null end as target
    from (select distinct page_id, url, href from {NAV_SQL})""")
def _(t):
    found = t.pages.select("page_id", "url", F.explode(markup.anchors("html")).alias("a"))
    return found.select("page_id", "url", "a.href").distinct().withColumn("target", urls.absolute_url("url", "href"))


@q("c12_site_of_url", r"""select page_id, split_part(h, '.', -1) as site_key, h = 'spam-farm.example.org' as is_farm
    from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as h from pages)""")
def _(t):
    # The registry of sites is the set of hosts themselves, so every page finds its site.
    hosts = t.pages.select(urls.host("url").alias("h")).distinct()
    sites = hosts.select(F.substring_index("h", ".", -1).alias("site_key"), F.concat(F.lit("https://"), F.upper("h")).alias("base_url"))
    joined = urls.with_site_key(t.pages.select("page_id", "url"), sites, url="url")
    return joined.select("page_id", "site_key", urls.is_url_for_site("url", F.lit("https://spam-farm.example.org/x")).alias("is_farm"))


@q("c13_with_page", r"""select page_id, case when n <= 1 then url
    when regexp_matches(url, '[?&](page|paged|pageindex)=') then regexp_replace(url, '([?&])(page|paged|pageindex)=[^&#]*', '\1\2=' || n)
    when url like '%?%' then regexp_replace(url, '^([^#]*)(#.*)?$', '\1&page=' || n || '\2')
    else regexp_replace(url, '^([^#]*)(#.*)?$', '\1?page=' || n || '\2') end as url
    from (select url, page_id, length(url) - 30 as n from pages)""")
def _(t):
    return t.pages.select("page_id", urls.with_page("url", F.length("url") - 30).alias("url"))


@q("c14_desktop_url", r"select page_id, regexp_replace(url, '^([a-z]+://)(?:m|mobile)\.', '\1') as url from pages")
def _(t):
    return t.pages.select("page_id", urls.desktop_url("url").alias("url"))


@q("c15_work_url", r"""select page_id, regexp_replace(url, '^([a-z]+://[^/]*)/(?:en/?)?([^?#]*?)/?((?:[?#].*)?)$', '\1/works/\2\3') as url from pages""")
def _(t):
    return t.pages.select("page_id", urls.work_url("url", F.lit("https://home.example/"), prefix="works", listing="en").alias("url"))


@q("c16_clean_base_url", r"""select page_id, case when v = '' then null when regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:') then v else 'https://' || v end as base
    from (select page_id, regexp_replace(regexp_replace(url, '[!?#''"]+$', ''), '[/ ]+$', '') as v from
      (select page_id, case when url like 'http:%' then substr(url, 8) else url end as url from pages))""")
def _(t):
    raw = F.when(F.col("url").startswith("http:"), F.substring("url", 8, 1000000)).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.clean_base_url(F.concat(F.lit(" "), raw, F.lit("/!?"))).alias("base"))


@q("c17_category_name", "select o_orderkey, case when o_orderstatus = 'F' then o_orderpriority else 'found' end as category from orders")
def _(t):
    cats = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("url"))))
    return t.orders.select("o_orderkey", text.category_name(cats, F.lit("found")).alias("category"))


@q("c18_content_hash", "select doc_id, sha256(text) as hash from documents")
def _(t):
    return t.documents.select("doc_id", text.content_hash("text").alias("hash"))


@q("c19_title_from_slug", """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from part""")
def _(t):
    return t.part.select("p_partkey", text.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@q("c21_retry_delays", """select event_id, cast(least(60, 5 * power(2, fails)) as bigint) as backoff, cast(3 * fails as bigint) as linear,
    ts + to_seconds(3 * fails) as retry_at
    from (select event_id, ts, cast(json_extract_string(props, '$.k') as bigint) as fails from events)""")
def _(t):
    e = t.events.select("event_id", "ts", F.get_json_object("props", "$.k").try_cast("bigint").alias("fails"))
    linear = text.linear_delay_seconds(F.lit(3), "fails")
    return e.select("event_id", text.backoff_seconds("fails").alias("backoff"), linear.alias("linear"),
                    (F.col("ts") + F.make_dt_interval(secs=linear)).alias("retry_at"))


@q("c23_parse_warning", """select o_orderkey, 'Work ' || o_custkey as story_title, o_custkey as crawled_count, 2::bigint as dead_count,
    o_orderkey as total_count from orders""")
def _(t):
    line = F.concat(F.lit("10:00 [WARNING] Sau crawl bù, truyện 'Work "), F.col("o_custkey"), F.lit("' vẫn thiếu chương: "),
                    F.col("o_custkey"), F.lit("+2/"), F.col("o_orderkey"))
    return t.orders.select("o_orderkey", text.parse_warning(line).alias("w")).select("o_orderkey", "w.*")


@q("c25_title_equality", """select a.p_partkey, lower(trim(a.p_name)) = lower(trim(a.p_brand)) as same_brand,
    lower(trim('  ' || upper(a.p_name))) = lower(trim(a.p_name)) as same_name from part a""")
def _(t):
    key = text.title_equal_key
    return t.part.select("p_partkey", (key("p_name") == key("p_brand")).alias("same_brand"),
                         (key(F.concat(F.lit("  "), F.upper("p_name"))) == key("p_name")).alias("same_name"))


@q("c26_stored_body", """select doc_id, 'Nguon: ' || source || chr(10) || chr(10) || 'Truyen: ' || lang || chr(10) || 'The loai: ' || source
    || chr(10) || 'Chuong: ' || doc_id || chr(10) || chr(10) || text as body from documents""")
def _(t):
    return t.documents.select("doc_id", text.stored_body("source", "lang", "source", "doc_id", "text").alias("body"))


@q("c27_percent", "select l_orderkey, case when max(l_linenumber) > 0 then count(distinct l_linenumber) * 100.0::double / max(l_linenumber) else 0 end as pct from lineitem group by 1")
def _(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("done"), F.max("l_linenumber").alias("total"))
    return counts.select("l_orderkey", text.percent("done", "total").alias("pct"))


@q("c28_unescape", f"select page_id, {UNESCAPE.format('html')} as html from pages")
def _(t):
    return t.pages.select("page_id", text.unescape("html").alias("html"))


@q("c28_escape", """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as html from pages""")
def _(t):
    return t.pages.select("page_id", text.escape("html").alias("html"))


@q("c29_chunks", """select doc_id, i as pos, substr(text, cast(i * 4000 + 1 as bigint), 4000) as piece from
    (select doc_id, text, unnest(range(0, (length(text) + 3999) // 4000)) as i from documents)""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(text.chunks("text")).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("bigint"))


# The default rules plus four that the test texts trigger (two literals, two expressions).
RULES = [*fixed.BLACKLIST_PATTERNS, "licensed under", "all rights", r"^the \w+\.?$", r"[0-9]{3}-[0-9]{4}"]
_RULES_SQL = "(?i)" + "|".join(f"(?:{p})" for p in RULES).replace("'", "''")
D1_SQL = rf"""array_to_string(list_filter(list_transform(string_split({{0}}, chr(10)),
    lambda x: regexp_replace(x, '^[\s\x{{{{00A0}}}}]+|[\s\x{{{{00A0}}}}]+$', '', 'g')),
    lambda x: x <> '' and not regexp_matches(x, '{_RULES_SQL.replace("{", "{{").replace("}", "}}")}')
      and (length(x) >= 5 or regexp_matches(x, '[.?!:"'']$'))), chr(10))"""


@q("d1_filter_lines", f"select doc_id, {D1_SQL.format('text')} as kept from documents")
def _(t):
    return t.documents.select("doc_id", lines.filter_lines("text", RULES).alias("kept"))


@q("d2_block_page", r"""select page_id, variant, case
      when regexp_matches(l, 'bạn đã bị chặn|checking your browser|ddos protection by cloudflare|verifying you are human|enable javascript and cookies to continue|cloudflare''s security check') then true
      when l like '%just a moment%' and l like '%cloudflare%' then true
      when length(doc) < 100 then false
      when regexp_matches(lower(regexp_extract(doc, '(?is)<title[^>]*>(.*?)</title>', 1)), 'just a moment|checking your browser|ddos|cloudflare|attention required|access denied|checking connection') then true
      when l like '%<body%' and (l like '%enable javascript%' or l like '%turn on javascript%') and
        len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(doc, '(?is)<body[^>]*>(.*?)(?:</body\s*>|$)', 1), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+'), lambda w: w <> '')) < 50 then true
      else false end as blocked
    from (select *, lower(doc) as l from (
      select page_id, 'plain' as variant, html as doc from pages
      union all select page_id, 'title', replace(html, '<title>', '<title>Attention Required! ') from pages
      union all select page_id, 'script', '<html><body><p>Please turn on JavaScript to read ' || url || ' and come back later to this page.</p></body></html>' from pages
      union all select page_id, 'phrase', 'Bạn đã BỊ chặn ' || url from pages))""")
def _(t):
    p = t.pages
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), d.alias("doc")) for n, d in {
        "plain": F.col("html"),
        "title": F.replace("html", F.lit("<title>"), F.lit("<title>Attention Required! ")),
        "script": F.concat(F.lit("<html><body><p>Please turn on JavaScript to read "), "url", F.lit(" and come back later to this page.</p></body></html>")),
        "phrase": F.concat(F.lit("Bạn đã BỊ chặn "), "url"),
    }.items()])
    return p.select("page_id", F.explode(variants).alias("v")).select("page_id", "v.variant", lines.is_block_page("v.doc").alias("blocked"))


@q("d3_drop_leading_headers", r"""select doc_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)), '^\s+|\s+$', '', 'g') as body from documents""")
def _(t):
    body = F.concat(F.lit("Nguồn: x\n\n TRUYỆN: y\nChương: 1\n\n"), "text")
    return t.documents.select("doc_id", lines.drop_leading_headers(body).alias("body"))
