"""J: job routing, alerts and state, as batch twins with SQL and as real streams over the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.catalog.registry import Catalog
from serialake.catalog.pages import ARTICLE, TO_TEXT
from serialake.sources import jobs as job_io
from serialake.streaming import jobs, ordered, runs, stateful, timers

catalog = Catalog()
q = catalog.query


def event_stream(t) -> DataFrame:
    """The events table as a file stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


_ROUTES = {"view": "single_story", "click": "full_site", "purchase": "retry_chapter", "signup": "all_sites"}


def messages(events: DataFrame) -> DataFrame:
    """One JSON message per event; errors have no known type, low values lack a required field, high ones are broken."""
    kind = F.col("event_type")
    route = F.coalesce(*[F.when(kind == k, v) for k, v in _ROUTES.items()], F.lit("surprise"))
    filled = F.when(F.col("value") >= 5, F.col("user_id").cast("string"))
    job = F.to_json(F.struct(F.when(F.col("value") < 90, route).alias("type"), filled.alias("title"), filled.alias("site_key"), filled.alias("chapter_url"),
                             filled.alias("chapter_title"), filled.alias("story_title"), filled.alias("filename")))
    return events.select("event_id", F.when(F.col("value") > 120, F.substring(job, 2, 20)).otherwise(job).alias("value"))


ROUTED_SQL = """(select event_id, case when value > 120 then 'bad_json' when value >= 90 then 'missing_type' when event_type = 'error' then 'unknown_type'
    when value < 5 and event_type in ('view', 'click', 'purchase') then 'missing_field' end as rejected,
    case event_type when 'view' then 'single_story' when 'click' then 'full_site' when 'purchase' then 'retry_chapter' when 'signup' then 'all_sites' end as route from events)"""


@q("j1_routed_jobs", f"select event_id, rejected, case when rejected is null then route else 'rejected' end as route from {ROUTED_SQL}")
def _(t):
    return jobs.parse_jobs(messages(t.events)).select("event_id", "rejected", "route")


@q("j1_routed_jobs_stream", f"select event_id, rejected, case when rejected is null then route else 'rejected' end as route from {ROUTED_SQL}")
def _(t):
    out = runs.work_folder(t.spark, "routes")
    runs.run_batches(jobs.parse_jobs(messages(event_stream(t))), jobs.route_sink(out), name="j1")
    return t.spark.read.schema("event_id bigint, rejected string, route string").parquet(out).select("event_id", "rejected", "route")


def warning_log(events: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    line = F.concat(F.lit("["), F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO"), F.lit("] Sau crawl bù, truyện '"), title, F.lit("' vẫn thiếu chương: "),
                    F.col("user_id"), F.lit("+1/"), F.col("event_id"))
    return events.select("event_id", line.alias("line"))


_WARNED_SQL = """(select event_id, 'Customer#' || lpad(cast(user_id as varchar), 9, '0') as story_title, user_id as crawled_count, 1::bigint as dead_count, event_id as total_count from events where event_type = 'error')"""


@q("j2_warning_jobs", f"select 'missing_check' as type, story_title, crawled_count, dead_count, total_count from {_WARNED_SQL}")
def _(t):
    return jobs.warning_jobs(warning_log(t.events)).drop("raw_line", "timestamp")


@q("j2_warning_jobs_stream", f"select 'missing_check' as type, story_title, crawled_count, dead_count, total_count from {_WARNED_SQL}")
def _(t):
    folder = runs.work_folder(t.spark, "log")
    warning_log(t.events).select("line").write.text(folder)
    tailed = job_io.tail_log(t.spark, folder, since="2000-01-01 00:00:00", glob="*.txt")
    return runs.run_available(jobs.warning_jobs(tailed), name="j2").drop("raw_line", "timestamp")


def works(t) -> DataFrame:
    return t.customer.where("c_acctbal > 0").select(F.upper(F.concat(F.lit(" "), "c_name")).alias("title"), F.col("c_custkey").alias("slug"))


@q("j3_repair_requests", f"""select story_title, total_count, c_custkey as work_slug, case when c_custkey is null then 'unknown_work' end as rejected
    from {_WARNED_SQL} left join (select * from customer where c_acctbal > 0) on c_name = story_title""")
def _(t):
    requests = jobs.repair_requests(jobs.warning_jobs(warning_log(t.events)), works(t))
    return requests.select("story_title", "total_count", "work_slug", "rejected")


@q("j3_repair_requests_stream", f"""select story_title, total_count, c_custkey as work_slug, case when c_custkey is null then 'unknown_work' end as rejected
    from {_WARNED_SQL} left join (select * from customer where c_acctbal > 0) on c_name = story_title""")
def _(t):
    requests = jobs.repair_requests(jobs.warning_jobs(warning_log(event_stream(t))), works(t))
    return runs.run_available(requests.select("story_title", "total_count", "work_slug", "rejected"), name="j3")


@q("e8_title_lookup", "select event_id, c_custkey as work_slug from events left join (select * from customer where c_acctbal > 0) on c_custkey = user_id")
def _(t):
    titled = t.events.select("event_id", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("  ")).alias("t"))
    return jobs.match_titles(titled, works(t), title="t").select("event_id", "work_slug")


_DEAD_SQL = """(select user_id, ts, 12::bigint as failures from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type = 'error') where rn = 12)"""


@q("j4_dead_keys", f"select user_id, failures, ts from {_DEAD_SQL}")
def _(t):
    return stateful.dead_keys_batch(t.events.where("event_type = 'error'"), key="user_id", time="ts", tie="event_id", cap=12)


@q("j4_dead_keys_stream", f"select user_id, failures, ts from {_DEAD_SQL}")
def _(t):
    dead = stateful.dead_keys(event_stream(t).where("event_type = 'error'"), key="user_id", time="ts", cap=12)
    return runs.run_available(dead, name="j4").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def members(t) -> DataFrame:
    """Nation of every customer that can be a user: the pools of J5 and J6."""
    return t.customer.where("c_custkey < 150").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("pool"))


def pools(t) -> DataFrame:
    return members(t).groupBy("pool").agg(F.count("*").alias("size"))


_MEMBERS = "(select c_custkey as user_id, c_nationkey as pool from customer where c_custkey < 150)"
_BANS_SQL = f"""(select user_id, pool, ts from (select *, row_number() over (partition by pool order by ts, user_id) as turn from (
        select user_id, pool, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events join {_MEMBERS} using (user_id) where event_type = 'error' and (user_id >= 50 or user_id % 10 <> 0)) where rn = 3)
      join (select pool, count(*) as size from {_MEMBERS} group by 1) using (pool) where turn < size)"""


def spared() -> Column:
    """Every tenth key below 50 is exempt; for the others the test is unknown."""
    return F.when(F.col("user_id") < 50, F.col("user_id") % 10 == 0)


@q("j5_bans", f"select user_id, pool, ts, 3::bigint as failures from {_BANS_SQL}")
def _(t):
    failures = t.events.where("event_type = 'error'").join(members(t), "user_id")
    return stateful.bans_batch(failures, key="user_id", time="ts", tie="event_id", pools=pools(t), exempt=spared())


@q("j5_bans_stream", f"""with f as (select user_id, pool, ts, lead(ts) over (partition by user_id order by ts) as nxt from events join {_MEMBERS} using (user_id) where event_type = 'error'),
    free as (select user_id, pool, ts + interval 36 hours as ts from f where nxt >= ts + interval 36 hours or nxt is null and ts + interval 36 hours <= (select max(ts) from f))
    select user_id, pool, ts, 'ban' as event from {_BANS_SQL} union all
    select user_id, pool, ts, 'usable' from free where not exists (select 1 from {_BANS_SQL} b where b.user_id = free.user_id and b.ts <= free.ts)""")
def _(t):
    failures = event_stream(t).where("event_type = 'error'").join(members(t), "user_id")
    events = timers.ban_events(failures, pools(t), key="user_id", pool="pool", time="ts", cooldown=36 * 3600, exempt=spared())
    return runs.run_available(events, name="j5").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@q("j5_cooldowns", "select user_id, max(ts) as last_failure, max(ts) + interval 60 seconds as available_at from events where event_type = 'error' group by 1")
def _(t):
    return stateful.cooldowns(t.events.where("event_type = 'error'"), key="user_id", time="ts")


@q("j6_trailing_counts", """select event_id, count(*) over (order by epoch_us(ts) range between 21599999999 preceding and current row) as recent from events where event_type = 'error'""")
def _(t):
    failures = t.events.where("event_type = 'error'").select("event_id", "ts")
    return stateful.trailing_counts(failures, time="ts", seconds=6 * 3600).select("event_id", "recent")


_STILL_RECENT = "list_filter(w.recent, lambda x: epoch_us(e.ts) - epoch_us(x) < 21600000000)"


@q("j6_ban_alerts_stream", f"""with recursive e as (select pool, ts, row_number() over (partition by pool order by ts, event_id) as rn from events join {_MEMBERS} using (user_id) where event_type = 'error'),
    walk as (select distinct pool, 0::bigint as rn, []::timestamp[] as recent, null::timestamp as ts, 0::bigint as n from e union all
      select e.pool, e.rn, case when len({_STILL_RECENT}) >= 2 then []::timestamp[] else list_append({_STILL_RECENT}, e.ts) end, e.ts, (len({_STILL_RECENT}) + 1)::bigint
      from walk w join e on e.pool = w.pool and e.rn = w.rn + 1) select pool, ts, n as bans from walk where n >= 3""")
def _(t):
    bans = event_stream(t).where("event_type = 'error'").join(members(t), "user_id")
    sink = ordered.alert_sink(runs.work_folder(t.spark, "j6"), pool="pool", time="ts", seconds=6 * 3600, threshold=3)
    runs.run_batches(bans, sink, name="j6")
    return sink.emitted(t.spark, bans.schema["pool"].dataType, "bans").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def debounced(t, name: str, hours: int) -> DataFrame:
    sink = ordered.debounce_sink(runs.work_folder(t.spark, name), key="user_id", time="ts", seconds=hours * 3600)
    runs.run_batches(event_stream(t), sink, name=name)
    return sink.emitted(t.spark, t.events.schema["user_id"].dataType).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


_DEBOUNCED_SQL = """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts) as rn from events),
    walk as (select user_id, rn, ts, ts as last, true as passed from e where rn = 1
      union all select e.user_id, e.rn, e.ts, case when e.ts >= w.last + interval {0} hours then e.ts else w.last end, e.ts >= w.last + interval {0} hours
      from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1) select user_id, ts from walk where passed"""


@q("j7_debounce_stream", _DEBOUNCED_SQL.format(6))
def _(t):
    return debounced(t, "j7", 6)


@q("j8_suppress_repeats_stream", _DEBOUNCED_SQL.format(30))
def _(t):
    return debounced(t, "j8", 30)


@q("j9_notify_once", "select distinct user_id from events where event_type = 'error'")
def _(t):
    return jobs.notify_once(t.events.where("event_type = 'error'").select(F.col("user_id")), title="user_id")


@q("j9_notify_once_stream", "select distinct user_id from events where event_type = 'error'")
def _(t):
    return runs.run_available(jobs.notify_once(event_stream(t).where("event_type = 'error'").select("user_id"), title="user_id"), name="j9")


@q("j11_due_retries", """with done as (select user_id, max(ts) as done from events where event_type = 'purchase' and value > 90 group by 1),
    f as (select user_id, count(*) as attempt, max(ts) as last_failure from events left join done using (user_id) where event_type = 'error' and (done is null or ts > done) group by 1),
    d as (select *, ((attempt - 1) % 5 + 1)::bigint as round, case when (attempt - 1) % 5 + 1 = 5 then 1800 else cast(least(3600, 5 * power(2, (attempt - 1) % 5 + 1)) as bigint) end as delay from f)
    select user_id, attempt, last_failure, round, delay::bigint as delay, last_failure + to_seconds(delay) as next_retry_at from d where last_failure + to_seconds(delay) <= timestamp '2024-01-30'""")
def _(t):
    done = t.events.where("event_type = 'purchase' and value > 90")
    return jobs.due_retries(t.events.where("event_type = 'error'"), done, key="user_id", time="ts", now=F.lit("2024-01-30").cast("timestamp_ntz"), ceiling=3600)


@q("j11_retry_rounds_stream", """with o as (select user_id, ts, event_type <> 'error' as ok from events where event_type = 'error' or event_type = 'purchase' and value > 90),
    g as (select *, lead(ts) over (partition by user_id order by ts, ok) as nxt, count(*) filter (ok) over (partition by user_id order by ts, ok rows unbounded preceding) as run from o),
    a as (select *, row_number() over (partition by user_id, run order by ts) as attempt from g where not ok),
    d as (select *, ((attempt - 1) % 5 + 1)::bigint as round, case when (attempt - 1) % 5 + 1 = 5 then 1800 else cast(least(3600, 5 * power(2, (attempt - 1) % 5 + 1)) as bigint) end as delay from a)
    select user_id, attempt, ts as last_failure, round, delay::bigint as delay, ts + to_seconds(delay) as next_retry_at from d
    where ts + to_seconds(delay) <= coalesce(nxt, (select max(ts) from o))""")
def _(t):
    outcomes = event_stream(t).where("event_type = 'error' or event_type = 'purchase' and value > 90")
    due = runs.run_available(timers.retry_rounds(outcomes, key="user_id", time="ts", ok=F.col("event_type") != "error", ceiling=3600), name="j11")
    return due.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_failure", "next_retry_at")})


def retry_stream_jobs(events: DataFrame) -> DataFrame:
    """A retry job per event, for the page whose id is the event's user; low values miss their file name."""
    user = F.col("user_id").cast("string")
    return events.select(F.col("user_id").alias("page_id"), F.lit("x").alias("site"), F.lit(None).cast("string").alias("site_key"), F.lit("c").alias("chapter_title"), F.lit("s").alias("story_title"),
                         F.when(F.col("value") >= 5, F.concat(user, F.lit(".txt"))).alias("filename"))


_RETRY_SQL = f"""(select url, user_id || '.txt' as filename, {TO_TEXT.format(ARTICLE)} as body from events join pages on page_id = user_id where value >= 5)"""


@q("j12_retry_results", f"""select filename, 'ok' as outcome, 'Nguon: ' || url || chr(10) || chr(10) || 'Truyen: s' || chr(10) || 'The loai: ' || chr(10) || 'Chuong: c' || chr(10) || chr(10) || body as text from {_RETRY_SQL}""")
def _(t):
    urls = t.pages.select("page_id", F.col("url").alias("chapter_url"))
    asked = retry_stream_jobs(t.events).join(urls, "page_id")
    return jobs.retry_results(asked, t.pages).select("filename", "outcome", "text")


@q("j12_retry_stream", f"select distinct filename, 'new' as label from {_RETRY_SQL}")
def _(t):
    urls = t.pages.select("page_id", F.col("url").alias("chapter_url"))
    asked = retry_stream_jobs(event_stream(t)).join(urls, "page_id")
    store, labels = runs.work_folder(t.spark, "store"), runs.work_folder(t.spark, "labels")
    sink, pages = jobs.retry_sink(store, labels), t.pages
    # Equal jobs of a batch have one result.
    runs.run_batches(asked, lambda batch, number: sink(jobs.retry_results(batch.distinct(), pages), number), name="j12")
    return t.spark.read.parquet(labels).select("filename", "label")
