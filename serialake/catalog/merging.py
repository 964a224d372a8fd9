"""E9, E10, G2, G3, I: merge and repair on the registry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialake.catalog.filters import HOLES_SQL, holes
from serialake.catalog.registry import Catalog
from serialake.functions import lines, text
from serialake.operators import merging

catalog = Catalog()
q = catalog.query


def t0():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def t1():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@q("e9_upsert", """select c_custkey, case when seg = 'BUILDING' or nm = '' then c_name else nm end as name, case when bal is null then c_acctbal else bal end as balance, created_at, updated_at, changed from (
    select c_custkey, c_name, c_acctbal, c_mktsegment as seg, case when c_mktsegment = 'BUILDING' then null when c_acctbal < 0 then '' else upper(c_name) end as nm,
      case when c_nationkey < 10 and c_mktsegment <> 'BUILDING' then c_acctbal + 1 end as bal, timestamp '2024-01-01' as created_at,
      case when c_mktsegment = 'BUILDING' then timestamp '2024-01-01' else timestamp '2024-02-01' end as updated_at,
      c_mktsegment <> 'BUILDING' and (c_acctbal >= 0 or c_nationkey < 10) as changed from customer)""")
def _(t):
    stored = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), t0().alias("created_at"), t0().alias("updated_at"))
    incoming = t.customer.where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.upper("c_name")).alias("name"),
        F.when(F.col("c_nationkey") < 10, F.col("c_acctbal") + 1).alias("balance"))
    return merging.upsert(stored, incoming, key=["c_custkey"], truthy=["name"], not_null=["balance"], now=t1())


@q("e10_append_category", """select n_nationkey, array_to_string(list_sort([lower(n_name), lower(r_name)] || case when n_regionkey > 2 then ['home'] else [] end), ',') as names
    from nation join region on r_regionkey = n_regionkey""")
def _(t):
    n = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    item = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    stored = F.array(item(F.col("n_name"), F.concat(F.lit("/n/"), "n_nationkey")), item(F.col("r_name"), F.concat(F.lit("/r/"), "r_regionkey")))
    grown = merging.append_category(stored, name=F.lit("Home"), url=F.when(F.col("n_regionkey") > 2, "/home").otherwise(F.concat(F.lit("/n/"), "n_nationkey")))
    return n.select("n_nationkey", F.array_join(F.transform(grown, lambda c: F.lower(c["name"])), ",").alias("names"))


def source_rows(t):
    """Suppliers of a part as its sources: the host names the supplier, the url is unique per supplier."""
    host = F.concat(F.lit("https://s"), "l_suppkey", F.lit(".example/p/"), "l_partkey")
    rows = t.lineitem.select(F.col("l_partkey").alias("work"), F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("origin"),
                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit(" "), host).alias("url"),
                             F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("priority"))
    sites = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("site"), "s_suppkey").alias("site_key"), F.concat(F.lit("http://S"), "s_suppkey", F.lit(".example")).alias("base_url"))
    return rows, sites


_SOURCES_SQL = """(select l_partkey as work, 'https://s' || l_suppkey || '.example/p/' || l_partkey as url, 'site' || l_suppkey as site_key,
    min(case when l_quantity > 40 then l_quantity end) as priority, min((case when l_returnflag = 'N' then 1 else 2 end) * 10000000000 + l_orderkey * 10 + l_linenumber) as first,
    min(l_orderkey * 10 + l_linenumber) as pos from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0 group by all)"""


@q("g2_merge_sources", f"""select work, row_number() over (partition by work order by coalesce(priority, 100), first, url) - 1 as place, url, site_key, priority from {_SOURCES_SQL}""")
def _(t):
    rows, sites = source_rows(t)
    return merging.merge_sources(rows, sites)


@q("g3_primary_sources", f"""select work, pos, url, site_key, pos = min(pos) over (partition by work) as is_primary,
    first_value(site_key) over (partition by work order by pos, site_key) as owner_key from {_SOURCES_SQL}""")
def _(t):
    rows, sites = source_rows(t)
    ordered = rows.select("work", "pos", F.trim("url").alias("url"), F.lit(None).cast("string").alias("site_key"))
    return merging.primary_sources(ordered, sites)


@q("i1_change_labels", """select doc_id, sha256(case when lang = 'fr' then text || ' more' else text end) as hash,
    case when lang = 'de' then 'new' when lang = 'fr' then 'updated' else 'unchanged' end as label
    from (select doc_id, lang, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))) as text from documents)""")
def _(t):
    clean = lines.drop_leading_headers("text")
    stored = t.documents.where("lang <> 'de'").select("doc_id", clean.alias("text"))
    edited = F.when(F.col("lang") == "fr", F.concat(clean, F.lit(" more"))).otherwise(clean)
    incoming = t.documents.select("doc_id", F.concat(F.lit("Nguồn: here\n"), edited).alias("text"))
    return merging.change_labels(stored, incoming, key=["doc_id"], content="text", cleaned=clean)


@q("i2_default_works", """select 'w-' || o_orderkey as slug, 'W ' || o_orderkey as title, 'https://home.example/w-' || o_orderkey as url, o_custkey as total, o_orderpriority as genre
    from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def _(t):
    folders = t.orders.select(F.concat(F.lit("w-"), "o_orderkey").alias("slug"), F.col("o_orderpriority").alias("genre"), F.col("o_custkey").alias("saved"))
    works = t.lineitem.select(F.concat(F.lit("w-"), "l_orderkey").alias("slug")).distinct()
    made = merging.default_works(folders, works, site_key=F.lit("home"), base_url=F.lit("https://home.example/"))
    return made.select("slug", "title", "url", "total", F.col("categories")[0]["name"].alias("genre"))


@q("i3_repair_works", f"""select c_custkey, coalesce(nullif(title, ''), 'C ' || c_custkey) as title, coalesce(url, case when source = 'BUILDING' and total > 10 then '/alt/' || c_custkey end) as url,
    case when url is null and not (source = 'BUILDING' and total > 10) then 'missing_url_title' end as skip_reason,
    case when url is null and not (source = 'BUILDING' and total > 10) then 'skip' when total >= 1 then 'ok' when source = 'MACHINERY' then 'drop' else 'retry' end as repair from {HOLES_SQL}""")
def _(t):
    none = F.lit(None).cast("string")
    alt = F.when(F.col("total") > 10, F.concat(F.lit("/alt/"), "c_custkey"))
    works = holes(t).select("c_custkey", F.concat(F.lit("c-"), "c_custkey").alias("slug"), "title", "url", "total",
                            F.array(F.struct(F.lit("").alias("url"), none.alias("title")), F.struct(alt.alias("url"), none.alias("title"))).alias("sources"),
                            F.when(F.col("source") == "MACHINERY", 3).otherwise(0).alias("retries"), F.lit(False).alias("skip_crawl"), none.alias("skip_reason"))
    return merging.repair_works(works).select("c_custkey", "title", "url", "skip_reason", "repair")


@q("i4_shape_repair", """select o_orderkey, case when o_orderstatus = 'O' then 'unknown' else o_orderpriority end as category,
    case when o_orderstatus = 'P' then '/other:7.0' else '/o/' || o_orderkey || ':100.0' end as source from orders""")
def _(t):
    cats = merging.default_categories(F.when(F.col("o_orderstatus") != "O", merging.repair_categories(F.array("o_orderpriority"))))
    given = F.when(F.col("o_orderstatus") == "P", F.array(F.struct(F.lit("/other").alias("url"), F.lit("x").alias("site_key"), F.lit(7.0).alias("priority"))))
    sources = merging.default_sources(given, url=F.concat(F.lit("/o/"), "o_orderkey"), site_key=F.lit("home"))
    return t.orders.select("o_orderkey", cats[0]["name"].alias("category"), F.concat(sources[0]["url"], F.lit(":"), sources[0]["priority"].cast("string")).alias("source"))


@q("i5_skip_marks", """select lower(c_name) as slug, '/c/' || c_custkey as url, c_name as title, case when c_mktsegment = 'BUILDING' then 'again' else 'old' end as reason,
    case when c_mktsegment = 'BUILDING' then timestamp '2024-02-01' else timestamp '2024-01-01' end as time from customer where c_acctbal < 5000 or c_mktsegment = 'BUILDING'""")
def _(t):
    rows = t.customer.select(F.lower("c_name").alias("slug"), F.concat(F.lit("/c/"), "c_custkey").alias("url"), F.col("c_name").alias("title"), "c_acctbal", "c_mktsegment")
    registry = rows.where("c_acctbal < 5000").select("slug", "url", "title", F.lit("old").alias("reason"), t0().alias("time"))
    marks = rows.where("c_mktsegment = 'BUILDING'").withColumn("reason", F.lit("again"))
    return merging.mark_skipped(registry, marks, time=t1())


@q("i5_clear_skips", """select c_custkey, c_mktsegment <> 'BUILDING' as skip_crawl, case when c_mktsegment <> 'BUILDING' then 'why' end as skip_reason,
    case when c_mktsegment = 'BUILDING' then 0 else 2 end as retries from customer""")
def _(t):
    works = t.customer.select("c_custkey", F.lower("c_name").alias("slug"), F.lit(True).alias("skip_crawl"), F.lit("why").alias("skip_reason"), F.lit(2).alias("retries"))
    restored = t.customer.where("c_mktsegment = 'BUILDING'").select(F.lower("c_name").alias("slug"))
    return merging.clear_skips(works, restored).drop("slug")


@q("i7_finished_genres", """select o_custkey, count(*) filter (o_orderstatus <> 'F') as open, count(*) filter (o_orderstatus = 'F') as done,
    count(*) filter (o_orderstatus <> 'F') = 0 and count(*) filter (o_orderstatus = 'F') > 0 as finished from orders group by 1""")
def _(t):
    return merging.finished_genres(t.orders, genre="o_custkey", in_progress=F.col("o_orderstatus") != "F", completed=F.col("o_orderstatus") == "F")
