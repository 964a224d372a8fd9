"""E: reconciliation on ``orders``/``lineitem`` (works and parts) and ``conversations`` (ordered parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.catalog.registry import Catalog
from serialake.catalog.scalars import FIRST_LINE, MATCH_KEY, PART_NUMBER, SLUG
from serialake.functions import text
from serialake.operators import reconcile
from serialake.operators.running import position

catalog = Catalog()
q = catalog.query

# --- works from lineitem: parts 1..max, N = stored, R = dead, open lines = offered by the source -----
_COMMON = "work bigint, pos bigint, index bigint, title string, url string, file string"


def order_parts(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    work = F.col("l_orderkey").alias("work")
    number = F.col("l_linenumber").cast("bigint")
    name = F.concat(F.lit("Chapter "), number.cast("string"))
    url = F.concat(F.lit("/w/"), number.cast("string"))
    none = F.lit(None).cast("string")
    tops = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("bigint").alias("top"))
    canonical = tops.select(work, F.explode(F.sequence(F.lit(1).cast("bigint"), "top")).alias("n")) \
                    .select("work", (F.col("n") - 1).alias("pos"), F.col("n").alias("index"), F.concat(F.lit("Chapter "), F.col("n").cast("string")).alias("title"),
                            F.concat(F.lit("/w/"), F.col("n").cast("string")).alias("url"), none.alias("file"))
    listed = t.lineitem.where("l_linestatus = 'O'").select(work, (number - 1).alias("pos"), number.alias("index"), name.alias("title"), url.alias("url"), none.alias("file"))
    saved = t.lineitem.where("l_returnflag = 'N'").select(work, F.format_string("%04d_x.txt", number).alias("file"), F.lit(100).alias("size"))
    dead = t.lineitem.where("l_returnflag = 'R' and l_quantity > 25").select(work, number.alias("index"), url.alias("url"))
    return canonical, listed, saved, dead


@q("e1_missing_parts", """select c.work, c.n as index, c.n - 1 as idx from (select l_orderkey as work, unnest(range(1, max(l_linenumber) + 1)) as n from lineitem group by 1) c
    where not exists (select 1 from lineitem s where s.l_orderkey = c.work and s.l_linenumber = c.n and s.l_returnflag = 'N')
      and not exists (select 1 from lineitem d where d.l_orderkey = c.work and d.l_linenumber = c.n and d.l_returnflag = 'R' and d.l_quantity > 25)
      and exists (select 1 from lineitem a where a.l_orderkey = c.work and a.l_linenumber = c.n and a.l_linestatus = 'O')""")
def _(t):
    return reconcile.missing_parts(*order_parts(t)).select("work", "index", "idx")


# --- conversations: the canonical list numbers turns from 1; the listing is shifted by the role ------
def conversation_parts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    first = F.substring_index("text", "\n", 1)
    none = F.lit(None).cast("string")
    c = t.conversations
    canonical = c.select(F.col("conv_id").alias("work"), F.col("turn").alias("pos"), (F.col("turn") + 1).alias("index"), first.alias("title"),
                         F.concat(F.lit("/c/"), F.col("turn").cast("string")).alias("url"), none.alias("file"))
    shift = F.when(F.col("role") == "user", 2).otherwise(F.when(F.length("text") > 400, 3).otherwise(4))
    listed = c.select(F.col("conv_id").alias("work"), F.col("turn").alias("pos"), (F.col("turn") + shift).cast("bigint").alias("index"), first.alias("title"),
                      F.concat(F.lit("/s/"), F.col("turn").cast("string")).alias("url"), none.alias("file"))
    saved = c.where("role = 'assistant'").select(F.col("conv_id").alias("work"), F.format_string("%04d_a.txt", F.col("turn") + 1).alias("file"), F.lit(10).alias("size"))
    return canonical, listed, saved


CANON_SQL = f"(select conv_id as work, turn as pos, turn + 1 as num, {MATCH_KEY.format(FIRST_LINE)} as key, role from conversations)"
LISTED_SQL = f"(select conv_id as work, turn as pos, turn + case when role = 'user' then 2 when length(text) > 400 then 3 else 4 end as num, {MATCH_KEY.format(FIRST_LINE)} as key from conversations)"
OFFSETS_SQL = f"""(with canon as (select distinct work, key, num from {CANON_SQL} where key <> ''),
    cnt as (select c.work, c.num - l.num as o, count(*) as n from canon c join {LISTED_SQL} l on l.work = c.work and l.key = c.key group by all),
    ranked as (select *, row_number() over (partition by work order by n desc, abs(o), o) as rn from cnt),
    tot as (select work, cast(sum(n) as bigint) as total, max(case when rn = 1 then o end) as "offset", cast(max(case when rn = 1 then n end) as bigint) as best,
        cast(coalesce(max(case when rn = 2 then n end), 0) as bigint) as second from ranked group by 1),
    m as (select l.work, count(*) as match_count from {LISTED_SQL} l where exists (select 1 from canon c where c.work = l.work and c.key = l.key) group by 1),
    sv as (select distinct conv_id as work from conversations where role = 'assistant')
  select w.work, coalesce("offset", 0)::bigint as "offset", coalesce(best, 0)::bigint as best, coalesce(second, 0)::bigint as second, coalesce(total, 0)::bigint as total,
    coalesce(match_count, 0)::bigint as match_count,
    (sv.work is not null and not coalesce((best >= 3 or best / total >= 0.6 or match_count <= 2) and not ("offset" <> 0 and second > 0 and best - second <= 1), false)) as skip
  from (select distinct work from canon) w left join tot using (work) left join m using (work) left join sv on sv.work = w.work)"""


@q("e2_numbering_offset", f"select * from {OFFSETS_SQL}")
def _(t):
    return reconcile.numbering_offsets(*conversation_parts(t))


@q("e3_aligned_listing", f"""select work, aligned, pos from (select l.work, l.pos, greatest(1, l.num + o."offset") as aligned,
    row_number() over (partition by l.work, greatest(1, l.num + o."offset") order by l.pos) as rn from {LISTED_SQL} l join {OFFSETS_SQL} o on o.work = l.work) where rn = 1""")
def _(t):
    canonical, listed, saved = conversation_parts(t)
    offsets = reconcile.numbering_offsets(canonical, listed, saved)
    aligned = reconcile.align_listed(listed.join(offsets.select("work"), "work", "left_semi"), offsets)
    return reconcile.first_aligned(aligned).select("work", "aligned", "pos")


@q("e1_missing_parts_shifted", f"""select c.work, c.num as index, c.pos as idx from {CANON_SQL} c left join {OFFSETS_SQL} o on o.work = c.work
    where not coalesce(o.skip, false) and c.role <> 'assistant'
      and exists (select 1 from {LISTED_SQL} l where l.work = c.work and greatest(1, l.num + coalesce(o."offset", 0)) = c.num)""")
def _(t):
    canonical, listed, saved = conversation_parts(t)
    dead = listed.limit(0).select("work", "index", "url")
    return reconcile.missing_parts(canonical, listed, saved, dead).select("work", "index", "idx")


@q("e4_skip_list", "select c_custkey from customer where c_mktsegment <> 'BUILDING'")
def _(t):
    from serialake.operators import registries
    skipped = t.customer.where("c_mktsegment = 'BUILDING'").select(F.lower("c_name").alias("slug"))
    works = t.customer.select("c_custkey", F.lower("c_name").alias("slug"))
    return registries.without_skipped(works, skipped, slug="slug").select("c_custkey")


@q("e5_completed_marks", "select o_orderkey, o_orderstatus = 'F' as completed, o_orderstatus <> 'F' as collect from orders")
def _(t):
    from serialake.operators import registries
    done = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return registries.mark_completed(t.orders.select("o_orderkey"), done, key="o_orderkey")


@q("e6_retry_jobs", """select l_orderkey as work, l_linenumber::bigint as index, '{"type":"retry_chapter","site":"' || o_orderpriority || '","chapter_url":"/w/' || l_linenumber
    || '","chapter_title":"Chapter ' || l_linenumber || '","story_title":"Work ' || l_orderkey || '","filename":"' || printf('%04d', l_linenumber) || '_chapter-' || l_linenumber || '.txt"}' as value
    from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R'""")
def _(t):
    number = F.col("l_linenumber").cast("bigint")
    dead = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("work"), number.alias("index"),
                                                         F.concat(F.lit("Chapter "), number.cast("string")).alias("title"), F.concat(F.lit("/w/"), number.cast("string")).alias("url"))
    works = t.orders.select(F.col("o_orderkey").alias("work"), F.concat(F.lit("Work "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("site_key"))
    return reconcile.retry_jobs(dead, works)


@q("e7_genre_completeness", """select p_brand as genre, count(*) filter (not exists (select 1 from part d where d.p_brand = p.p_brand and d.p_name = p.p_name and d.p_type = 'ECONOMY')) as missing,
    count(*) filter (not exists (select 1 from part d where d.p_brand = p.p_brand and d.p_name = p.p_name and d.p_type = 'ECONOMY')) = 0 as complete from part p group by 1""")
def _(t):
    listed = t.part.select(F.col("p_brand").alias("genre"), F.col("p_name").alias("title"))
    completed = t.part.where("p_type = 'ECONOMY'").select(F.col("p_brand").alias("genre"), F.col("p_name").alias("title"))
    return reconcile.genre_completeness(listed, completed)


@q("e11_misnamed_files", f"""select work, num::bigint as index, min(old_file) as old_file, new_file from (
      select conv_id as work, turn + 1 as num, printf('%04d', turn + 1) || '_' || coalesce(nullif({SLUG.format(FIRST_LINE)}, ''), 'untitled') || '.txt' as new_file, role from conversations) e
    join (select conv_id as fw, printf('%04d', turn + 1) || '_old.txt' as old_file, turn + 1 as fn from conversations where role = 'user') f on fw = work and fn = num
    group by all""")
def _(t):
    c = t.conversations
    first = F.substring_index("text", "\n", 1)
    expected = c.select(F.col("conv_id").alias("work"), (F.col("turn") + 1).alias("index"), text.part_file_name(first, F.col("turn") + 1).alias("file"))
    kept = c.where("role <> 'user'").select(F.col("conv_id").alias("work"), text.part_file_name(first, F.col("turn") + 1).alias("file"))
    old = c.where("role = 'user'").select(F.col("conv_id").alias("work"), F.format_string("%04d_old.txt", F.col("turn") + 1).alias("file"))
    return reconcile.misnamed_files(expected, kept.unionByName(old))


@q("e12_absent_files", """select c.work, c.n - 1 as pos, printf('%04d', c.n) || '_' || coalesce('t' || (select min(l_quantity::bigint) from lineitem t where t.l_orderkey = c.work and t.l_linenumber = c.n), 'untitled') || '.txt' as file
    from (select l_orderkey as work, unnest(range(1, max(l_linenumber) + 1)) as n from lineitem group by 1) c
    where not exists (select 1 from lineitem s where s.l_orderkey = c.work and s.l_linenumber = c.n and s.l_returnflag = 'N')""")
def _(t):
    number = F.col("l_linenumber").cast("bigint")
    works = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.max("l_linenumber").alias("total"))
    titles = t.lineitem.groupBy(F.col("l_orderkey").alias("work"), (number - 1).alias("pos")).agg(
        F.concat(F.lit("t"), F.min(F.col("l_quantity").cast("bigint")).cast("string")).alias("title"))
    expected = reconcile.expected_files(works, titles, work="work", total="total")
    stored = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("work"), (number - 1).alias("pos")).distinct()
    actual = expected.join(stored, ["work", "pos"], "left_semi").select("work", "file")
    return reconcile.absent_files(expected, actual, work="work")


@q("e13_canonical_source", """select work, source, total_parts from (select l_partkey as work, l_suppkey as source, count(*) as total_parts,
    row_number() over (partition by l_partkey order by l_suppkey) as rn from lineitem group by 1, 2) where rn = 1""")
def _(t):
    parts = t.lineitem.select(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("source"))
    return reconcile.canonical_source(parts, work="work", source="source", order="source")


@q("e14_source_fill", """select work, number, source from (select l_orderkey as work, l_linenumber as number, l_suppkey as source,
      row_number() over (partition by l_orderkey, l_linenumber order by l_suppkey) as rn from lineitem l where l_returnflag <> 'N'
      and not exists (select 1 from lineitem s where s.l_orderkey = l.l_orderkey and s.l_linenumber = l.l_linenumber and s.l_returnflag = 'N')) where rn = 1""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("number"), F.col("l_suppkey").alias("source"), "l_returnflag")
    filled = reconcile.fill_from_sources(rows.where("l_returnflag <> 'N'"), rows.where("l_returnflag = 'N'"), work="work", number="number", priority=["source"])
    return filled.select("work", "number", "source")


@q("e15_unprocessed", "select page_id from pages where url not like '%page=%'")
def _(t):
    from serialake.operators import registries
    seen = t.pages.where(F.col("url").contains("page=")).select("url")
    return registries.without_seen(t.pages.select("page_id", "url"), seen, key="url").select("page_id")
