"""F: counts, completeness and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialake.catalog.filters import part_works
from serialake.catalog.registry import Catalog
from serialake.functions import lines, markup, urls
from serialake.operators import stats

catalog = Catalog()
q = catalog.query

COUNTS_SQL = "(select l_orderkey as work, count(*) filter (l_returnflag <> 'R') as saved, count(*) filter (l_returnflag = 'R') as dead, max(l_linenumber)::bigint as top from lineitem group by 1)"


def counts(t):
    return stats.part_counts(t.lineitem.withColumnRenamed("l_orderkey", "work"), work="work", saved=F.col("l_returnflag") != "R", dead=F.col("l_returnflag") == "R")


@q("f1_part_counts", f"select work, saved, dead from {COUNTS_SQL}")
def _(t):
    return counts(t)


@q("f2_completeness", f"""select o_orderkey as work, e as expected, e > 0 and s + d >= e as complete, e > 0 and s > 0 and s < e as report_missing from (
    select o_orderkey, coalesce(saved, 0) as s, coalesce(dead, 0) as d, greatest(least(cast(left(o_orderpriority, 1) as bigint), 4), case when top > 0 then least(top, 4) else 0 end) as e
    from orders left join {COUNTS_SQL} on work = o_orderkey)""")
def _(t):
    tops = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.max("l_linenumber").cast("bigint").alias("top"))
    works = t.orders.select(F.col("o_orderkey").alias("work"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("stored"))
    joined = works.join(counts(t), "work", "left").join(tops, "work", "left")
    expected = stats.expected_total(stored=F.col("stored"), live=F.col("top"), limit=F.lit(4).cast("bigint"))
    return stats.completeness(joined.withColumn("expected", expected)).select("work", "expected", "complete", "report_missing")


@q("f3_library_summary", """select count(*) as total, count(*) filter (p_type = 'ECONOMY') as completed, count(*) filter (p_type <> 'ECONOMY') as ongoing,
    count(distinct case when p_brand <> 'Brand#1' then p_brand end) as genres from part""")
def _(t):
    works = part_works(t).withColumn("genre", F.when(F.col("genre") == "Brand#1", "Unknown").otherwise(F.col("genre")))
    out = stats.library_summary(works)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


@q("f4_top_genres", "select p_brand as genre, count(*) as works from part where p_brand <> 'Unknown' group by 1 order by works desc, genre limit 5")
def _(t):
    return stats.top_genres(part_works(t))


@q("f5_health", f"select count(*) filter (saved = 0) as skipped_works, cast(sum(dead) as bigint) as dead_parts, count(*) filter (dead > 0) as works_with_dead from {COUNTS_SQL}")
def _(t):
    totals, _, _ = stats.health(counts(t), skipped=F.col("saved") == 0)
    return totals


@q("f5_dead_works", f"select work, dead from {COUNTS_SQL} where dead > 0")
def _(t):
    return stats.health(counts(t), skipped=F.col("saved") == 0)[2].select("work", "dead")


@q("f6_storage_size", "select cast(sum(strlen(text)) as bigint) as bytes, sum(strlen(text)) / 1073741824.0::double as gib from documents")
def _(t):
    return stats.storage_size(t.documents, size=F.octet_length("text"))


_KINDS = {"view": "category", "click": "chapters", "purchase": "content", "signup": "content", "error": "category"}


@q("f7_extraction_metrics", "select user_id, " + ", ".join(
    f"count(*) filter (kind = '{k}' and outcome = '{o}') as {k}_{o}" for k in stats.METRIC_KINDS for o in stats.METRIC_OUTCOMES) + """, max(ts) as last_used_at
    from (select *, case event_type when 'view' then 'category' when 'error' then 'category' when 'click' then 'chapters' else 'content' end as kind,
      case when value < 5 then 'calls' when value < 20 then 'success' when value < 40 then 'fail' else 'cache_hit' end as outcome from events) group by 1""")
def _(t):
    kind = F.when(F.col("event_type").isin("view", "error"), "category").when(F.col("event_type") == "click", "chapters").otherwise("content")
    v = F.col("value")
    outcome = F.when(v < 5, "calls").when(v < 20, "success").when(v < 40, "fail").otherwise("cache_hit")
    events = t.events.withColumn("kind", kind).withColumn("outcome", outcome)
    return stats.extraction_metrics(events, domain="user_id", kind="kind", outcome="outcome", time="ts")


@q("f8_fetch_outcomes", "select user_id, count(*) filter (event_type in ('view', 'purchase')) as primary_success, count(*) filter (event_type in ('error', 'signup')) as fallback_count from events group by 1")
def _(t):
    kind = F.col("event_type")
    outcome = F.when(kind.isin("view", "purchase"), "ok").when(kind == "click", "dead_link").otherwise("unknown")
    return stats.fetch_outcomes(t.events, site="user_id", outcome=outcome)


@q("f9_capped_failures", "select user_id, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type = 'error') >= 10 as dead from events group by 1")
def _(t):
    return stats.capped_failures(t.events, key="user_id", failed=F.col("event_type") == "error", cap=10)


@q("f10_failed_works", f"select work, dead >= ceil(top * 2 / 3.0) as skip from {COUNTS_SQL}")
def _(t):
    tops = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.max("l_linenumber").cast("bigint").alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("dead"))
    return tops.select("work", stats.skip_by_failures(tops, failed="dead", total="top").alias("skip"))


@q("f11_paging_completeness", r"""select host, read, total, read < total as incomplete, read < total and attempts < 5 as retry from (
    select lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, count(*) as read, max(length(url))::bigint // 8 as total, count(*) filter (url like '%#top') as attempts from pages group by 1)""")
def _(t):
    hosts = t.pages.groupBy(urls.host("url").alias("host")).agg(
        F.count("*").alias("read"), F.floor(F.max(F.length("url")) / 8).alias("total"), F.count_if(F.col("url").endswith("#top")).alias("attempts"))
    return stats.paging_completeness(hosts, group="host", read="read", total="total", attempts="attempts")


@q("f12_refreshed_total", """select o_orderkey, case when n > 0 and n <> o then n else greatest(o, n) end as total from (
    select o_orderkey, cast(left(o_orderpriority, 1) as bigint) as o, coalesce(top, 0) as n from orders left join (select l_orderkey, max(l_linenumber)::bigint as top from lineitem group by 1) on l_orderkey = o_orderkey)""")
def _(t):
    tops = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("bigint").alias("top"))
    works = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("bigint").alias("stored")).join(tops, "o_orderkey", "left")
    return works.select("o_orderkey", stats.refreshed_total(stored=F.col("stored"), observed=F.col("top")).cast("bigint").alias("total"))


@q("f13_library_rows", f"""select o_orderkey as work, o_orderpriority as genre, total, s as saved, d as dead, total > 0 and s + d >= total as complete, total > 0 and s > 0 and s < total as report_missing from (
    select *, cast(left(o_orderpriority, 1) as bigint) as total, coalesce(saved, 0) as s, coalesce(dead, 0) as d from orders left join {COUNTS_SQL} on work = o_orderkey)""")
def _(t):
    works = t.orders.select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("genre"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("total"))
    return stats.library_rows(works, counts(t), work="work")


@q("f14_source_health", r"""select host, case when not g then 'genres' when not l then 'listings' when not d then 'detail' when not p then 'parts' when not c then 'content' end as failed_stage, g and l and d and p and c as healthy from (
    select lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, bool_or(html like '%<nav>%') as g, bool_or(url like '%page=%') as l, bool_or(html like '%<title>%') as d,
      bool_or(html like '%<li>%') as p, bool_or(length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article', 1)) >= 50) as c from pages group by 1)""")
def _(t):
    html = F.col("html")
    pages = t.pages.withColumn("host", urls.host("url"))
    return stats.source_health(pages, site="host", genres=html.contains("<nav>"), listings=F.col("url").contains("page="), detail=html.contains("<title>"),
                               parts=html.contains("<li>"), content=F.length(markup.container("html")) >= 50)
