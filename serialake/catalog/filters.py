"""D: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialake.catalog.registry import Catalog
from serialake.catalog.scalars import FIRST_LINE, PART_NUMBER
from serialake.functions import text, urls
from serialake.functions.lines import split_lines
from serialake.operators import filters, stats

catalog = Catalog()
q = catalog.query

def now():
    return F.lit("1999-01-01 00:00:00").cast("timestamp")


@q("d4_effective_limit", """select l_orderkey, l_partkey, l_linenumber, l_shipdate, lim from (
    select l.*, least(o.n, cast(left(o.o_orderpriority, 1) as bigint), 6, 2 * 3) as lim
    from lineitem l join (select o_orderkey, o_orderpriority, n from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey) o on o_orderkey = l_orderkey)
    where l_linenumber - 1 < lim""")
def _(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    works = t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", filters.effective_limit(listed="n", site_total=F.substring("o_orderpriority", 1, 1).cast("int"), caller_cap=F.lit(6), global_cap=None,
                                              max_pages=2, per_page=3).alias("lim"))
    parts = t.lineitem.join(works, "l_orderkey").withColumn("pos", F.col("l_linenumber") - 1)
    return filters.first_parts(parts, pos="pos", limit=F.col("lim")).select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "lim")


CONV_TITLE = f"case when role = 'user' then 'Chapter ' || (turn + 2) || ': ' || {FIRST_LINE} else {FIRST_LINE} end"


@q("d5_target_match", f"""select conv_id, turn, (turn in (1, 3)) or (coalesce(n, -1) - 1 in (1, 3)) or (length(role) - 1 in (1, 3)) as wanted
    from (select conv_id, turn, role, {PART_NUMBER.format('(' + CONV_TITLE + ')')} as n from conversations)""")
def _(t):
    first = F.substring_index("text", "\n", 1)
    title = F.when(F.col("role") == "user", F.concat(F.lit("Chapter "), F.col("turn") + 2, F.lit(": "), first)).otherwise(first)
    targets = F.array(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))
    wanted = filters.matches_target(targets, pos=F.col("turn"), idx=F.lit(None).cast("bigint"), index=F.length("role"), title=title)
    return t.conversations.select("conv_id", "turn", wanted.alias("wanted"))


@q("d5_target_index", f"""select conv_id, turn, case when i >= 0 then i end as target from (select conv_id, turn, coalesce(case when role = 'user' then turn end, n - 1) as i
    from (select conv_id, turn, role, {PART_NUMBER.format('(' + CONV_TITLE + ')')} as n from conversations))""")
def _(t):
    first = F.substring_index("text", "\n", 1)
    title = F.when(F.col("role") == "user", F.concat(F.lit("Chapter "), F.col("turn") + 2, F.lit(": "), first)).otherwise(first)
    none = F.lit(None).cast("bigint")
    target = filters.target_index(idx=F.when(F.col("role") == "user", F.col("turn")), index=none, aligned=none, title=title)
    return t.conversations.select("conv_id", "turn", target.alias("target"))


def part_works(t):
    return t.part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"), F.col("p_brand").alias("genre"),
                         F.when(F.col("p_type") == "ECONOMY", "completed").otherwise("ongoing").alias("status"),
                         F.col("p_size").cast("bigint").alias("total"))


@q("d6_library_filter", "select p_partkey as work from part where p_type = 'ECONOMY' and lower(p_brand) like '%brand#1%' and p_size between 10 and 30")
def _(t):
    return filters.library_filter(part_works(t), scope="completed", genre="BRAND#1", min_total=10, max_total=30).select("work")


# Works with holes: some names, balances and segments are absent.
HOLES_SQL = """(select c_custkey, case when c_acctbal < 0 then null when c_acctbal > 9000 then '' else c_name end as title,
    case when c_mktsegment = 'BUILDING' then null else 'https://works.example/' || c_custkey end as url,
    case when c_nationkey < 5 then 0 else c_nationkey end as total, c_mktsegment as source from customer)"""


def holes(t):
    return t.customer.select(
        "c_custkey", F.when(F.col("c_acctbal") > 9000, "").when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("title"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("https://works.example/"), "c_custkey")).alias("url"),
        F.when(F.col("c_nationkey") < 5, 0).otherwise(F.col("c_nationkey")).alias("total"), F.col("c_mktsegment").alias("source"))


@q("d7_missing_fields", f"""select c_custkey, concat_ws(',', case when title is null or title = '' then 'title' end, case when url is null then 'url' end,
    case when total = 0 then 'total' end) as falsy, concat_ws(',', case when title is null then 'title' end, case when url is null then 'url' end) as nulls from {HOLES_SQL}""")
def _(t):
    fields = ["title", "url", "total"]
    return holes(t).select("c_custkey", F.array_join(filters.missing_fields(fields, types={"total": "number"}), ",").alias("falsy"),
                           F.array_join(filters.missing_fields(fields, falsy=False), ",").alias("nulls"))


@q("d8_resume", """select o_custkey, o_orderkey, pos from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders)
    where pos >= length(cast(o_custkey as varchar)) and pos < 8""")
def _(t):
    from serialake.operators.running import position
    listed = position(t.orders.select("o_custkey", "o_orderkey"), key=["o_custkey"], order=["o_orderkey"], name="pos")
    return filters.resume(listed, pos="pos", start=F.length(F.col("o_custkey").cast("string")), cap=8)


@q("d9_foreign_sources", r"""select page_id from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as h from pages)
    where split_part(h, '.', 1) not in ('m', 'blog', 'www')""")
def _(t):
    # Every host is a site; a source claims the host without its first label when that is m, blog or www.
    host = urls.host("url")
    claimed = F.regexp_replace(host, r"^(m|blog|www)\.", "")
    hosts = t.pages.select(host.alias("h")).distinct()
    sites = hosts.select(F.col("h").alias("site_key"), F.concat(F.lit("http://"), "h").alias("base_url"))
    return filters.drop_foreign_sources(t.pages.select("page_id", "url", claimed.alias("site_key")), sites, url="url", site_key="site_key").select("page_id")


@q("d10_recent", """select event_id, case when event_type = 'view' then false when event_type = 'click' then true
    else cast(floor((epoch(timestamp '2024-01-20 00:00:00') - epoch(date_trunc('second', ts))) / 86400) as bigint) < 7 end as keep from events""")
def _(t):
    time = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", filters.is_recent(time, now=F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("keep"))


@q("d11_abandoned", """select o_orderkey from orders left join (select l_orderkey, count(*) filter (l_returnflag = 'A') as saved, count(*) filter (l_returnflag = 'R') as dead
    from lineitem group by 1) on l_orderkey = o_orderkey
    where (coalesce(saved, 0) + coalesce(dead, 0)) * 100.0 / 30 < 10 and floor((epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400) > 30""")
def _(t):
    counts = stats.part_counts(t.lineitem, work="l_orderkey", saved=F.col("l_returnflag") == "A", dead=F.col("l_returnflag") == "R")
    works = t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    test = filters.is_abandoned(saved="saved", dead="dead", total=F.lit(30), updated_at=F.col("o_orderdate").cast("timestamp"), now=now())
    return works.where(test).select("o_orderkey")


@q("d12_small_objects", "select doc_id, strlen(text) = 0 as is_empty, strlen(text) < 20 as too_small from documents")
def _(t):
    return t.documents.select("doc_id", filters.is_empty_object("text").alias("is_empty"), filters.is_too_small("text").alias("too_small"))


@q("d13_valid_jobs", "select event_id, event_type <> 'view' and value > 10 as valid from events")
def _(t):
    jobs = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("site"),
                           F.when(F.col("value") > 10, "x").otherwise("").alias("chapter_url"), F.lit("t").alias("chapter_title"),
                           F.lit("s").alias("story_title"), F.lit("f").alias("filename"))
    return jobs.select("event_id", filters.is_valid_job(["site", "chapter_url", "chapter_title", "story_title", "filename"]).alias("valid"))


@q("d14_log_lines", "select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '(?i)licen[sc]e|rights')")
def _(t):
    log = t.documents.select("doc_id", F.explode(split_lines("text")).alias("line"))
    return filters.select_log_lines(log, pattern="(?iu)licen[sc]e|rights")


@q("d15_suspicious", "select l_orderkey, count(*) < 0.1 * (10 * max(l_linenumber)) as suspicious from lineitem group by 1")
def _(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("saved"), F.max("l_linenumber").alias("top"))
    return counts.select("l_orderkey", filters.is_suspicious("saved", F.col("top") * 10).alias("suspicious"))


@q("d16_fetch_class", """select event_id, case event_type when 'view' then 'ok' when 'click' then 'dead_link' when 'error' then 'timeout' when 'signup' then 'anti_bot' else 'unknown' end as class from events""")
def _(t):
    kind = F.col("event_type")
    status = F.when(kind == "click", 404).when(kind == "purchase", 503).otherwise(200)
    body = F.when(kind == "signup", "Checking your browser before you go on").when(kind == "purchase", "").otherwise(F.col("props"))
    error = F.when(kind == "error", "Read Timeout")
    return t.events.select("event_id", filters.fetch_class(status=status, body=body, error=error).alias("class"))
