"""Job routing, log-derived requests, de-duplication and retries.

Every function is a plain DataFrame transformation, so the same code runs on a stream or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake import fixed, schemas
from serialake.functions import lines, markup, text
from serialake.materialise import checkpointed
from serialake.operators import filters
from serialake.operators.ordering import keep_first


def parse_jobs(messages: DataFrame, *, value: str = "value") -> DataFrame:
    """JSON payload to columns; ``rejected`` tells why a message cannot be dispatched (null when it can)."""
    parsed = messages.withColumn("job", F.from_json(value, f"{schemas.JOB}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    kind = F.col("job.type")
    absent = F.lit(False)
    for name, fields in fixed.JOB_REQUIRED_FIELDS.items():
        for field in fields:
            # A retry job may name its site either way.
            held = F.coalesce("job.site", "job.site_key") if field == "site" else F.col(f"job.{field}")
            absent = absent | ((kind == name) & (F.coalesce(held, F.lit("")) == ""))
    reason = (F.when(F.col("job").isNull() | F.col("job._corrupt").isNotNull(), "bad_json").when(F.coalesce(kind, F.lit("")) == "", "missing_type")
               .when(~kind.isin(*fixed.JOB_REQUIRED_FIELDS), "unknown_type").when(absent, "missing_field"))
    route = F.when(reason.isNull(), kind).otherwise(F.lit("rejected"))
    return parsed.select(*messages.columns, "job.*", reason.alias("rejected"), route.alias("route")).drop("_corrupt")


def route_sink(path: str):
    """``foreachBatch`` writer: one folder per batch and route; a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={batch_id}")
    return write


def warning_jobs(log: DataFrame, *, line: str = "line", job_type: str = "missing_check", at: Column | None = None) -> DataFrame:
    """Log lines to warning jobs: select, parse, build the payload columns."""
    hits = filters.select_log_lines(log, line=line).withColumn("w", text.parse_warning(line))
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return hits.select(F.lit(job_type).alias("type"), text.uni_trim(line).alias("raw_line"), "w.*", stamp.alias("timestamp"))


def match_titles(rows: DataFrame, works: DataFrame, *, title: str, work_title: str = "title", slug: str = "slug") -> DataFrame:
    """The first work whose title is the same apart from case and outer space (stream or batch left side).

    The works side is reduced to one row per title before the join, so a message matches at most once.
    """
    known = works.withColumn("__key", text.title_equal_key(work_title))
    unique = keep_first(known, key=["__key"], order=[slug]).select("__key", F.col(slug).alias("work_slug"))
    return rows.withColumn("__key", text.title_equal_key(title)).join(unique, "__key", "left").drop("__key")


def repair_requests(warnings: DataFrame, works: DataFrame, *, title: str = "story_title", work_title: str = "title", slug: str = "slug") -> DataFrame:
    """Warnings joined to their work; without title or work they are rejected."""
    matched = match_titles(warnings, works, title=title, work_title=work_title, slug=slug)
    reason = F.when(F.coalesce(title, F.lit("")) == "", "no_title").when(F.col("work_slug").isNull(), "unknown_work")
    return matched.withColumn("rejected", reason)


def notify_once(rows: DataFrame, *, title: str) -> DataFrame:
    """One notification per title."""
    return rows.where(F.coalesce(F.col(title).cast("string"), F.lit("")) != "").dropDuplicates([title])


def due_retries(failures: DataFrame, succeeded: DataFrame, *, key: str, time: str, now: Column, rounds: int = 5, base: int = 5, ceiling: int = 60,
                sleep: int = 1800) -> DataFrame:
    """Keys that failed since their last success and whose next attempt is due: attempt number, round, delay, time of the next try.

    No key is given up: after every ``rounds`` attempts the delay is the long ``sleep`` and the rounds begin again.
    """
    done = succeeded.groupBy(F.col(key).alias("__key")).agg(F.max(time).alias("__done"))
    since = failures.join(done, F.col(key) == F.col("__key"), "left").where(F.col("__done").isNull() | (F.col(time) > F.col("__done")))
    open_keys = since.groupBy(key).agg(F.count("*").alias("attempt"), F.max(time).alias("last_failure"))
    step = F.pmod(F.col("attempt") - 1, F.lit(rounds)) + 1
    delay = F.when(step == rounds, F.lit(sleep).cast("bigint")).otherwise(text.backoff_seconds(step, base, ceiling))
    planned = open_keys.withColumn("round", step.cast("bigint")).withColumn("delay", delay)
    return planned.withColumn("next_retry_at", F.col("last_failure") + F.make_dt_interval(secs=F.col("delay"))).where(F.col("next_retry_at") <= now)


def retry_results(jobs: DataFrame, pages: DataFrame, *, page_id: str = "page_id", landed: str | None = None, category: Column | None = None) -> DataFrame:
    """Retry jobs with the latest landed page of their url: outcome and, for good pages, the body to store.

    Invalid jobs are rejected before the join; the stored body is text, not markup. Of several landings the one with the greatest
    ``landed`` counts (ties and default: the greatest ``page_id``, which names a row). Urls meet jobs as hashes beside row ids; ``html``
    is read afterwards, by row id, for the pages that are needed, and becomes text once a page, however many jobs ask for it. A stream
    of jobs cannot tell which pages it needs, so there a page is read per job: call this in ``foreachBatch`` instead.
    """
    site = F.coalesce(F.nullif("site", F.lit("")), "site_key")
    valid = jobs.withColumn("site", site).where(filters.is_valid_job(["site", "chapter_url", "chapter_title", "story_title", "filename"]))
    order = F.struct(F.col(landed or page_id), F.col(page_id))
    newest = pages.where("url is not null").groupBy(F.xxhash64("url").alias("__hash"), F.sha1(F.col("url").cast("binary")).alias("__digest")).agg(F.max_by(F.col(page_id), order).alias("__row"))
    hashed = valid.withColumns({"__hash": F.xxhash64("chapter_url"), "__digest": F.sha1(F.col("chapter_url").cast("binary"))})
    placed = hashed.join(newest, ["__hash", "__digest"], "left")
    landings = pages.select(F.col(page_id).alias("__row"), "html")
    body = markup.fragment_to_text(F.coalesce(markup.container(markup.strip_code("html")), markup.strip_code("html")))
    # Steps, so that each expensive expression is evaluated once per row.
    facts = [(F.coalesce("html", F.lit("")) == "").alias("__empty"), lines.is_block_page("html").alias("__blocked"), body.alias("__body")]
    if jobs.isStreaming:
        joined = placed.join(landings, "__row", "left").select(*placed.columns, *facts)
    else:
        needed = landings.join(placed.select("__row").distinct(), "__row", "left_semi")
        joined = placed.join(needed.select("__row", *facts), "__row", "left")
    keep = ["filename", "chapter_url", "chapter_title", "story_title", "site"]
    read = joined.select(*keep, (F.lit("") if category is None else category).alias("__category"), F.coalesce("__empty", F.lit(True)).alias("__absent"),
                         "__blocked", "__body")
    outcome = F.when(F.col("__absent"), "not_landed").when(F.col("__blocked"), "anti_bot").when(F.col("__body") == "", "empty").otherwise("ok")
    stored = text.stored_body("chapter_url", "story_title", "__category", "chapter_title", "__body")
    return read.select("*", outcome.alias("outcome")).select(*keep, "outcome", F.when(F.col("outcome") == "ok", stored).alias("text"))


def retry_sink(store: str, label_path: str):
    """``foreachBatch`` writer: label each good result against what was stored (I1), append what is new or changed.

    The store is append-only by batch folder, newest batch wins on read, so replaying a batch is harmless. Labels come from a register
    of (file, content hash) per batch beside it; the stored texts are not read again.
    """
    register = f"{store}-register"

    def write(batch: DataFrame, batch_id: int) -> None:
        from serialake.sources.tree import _existing, latest_versions

        spark = batch.sparkSession
        good = keep_first(batch.where("outcome = 'ok'").select("filename", "text"), key=["filename"], order=["text"])
        good = good.withColumn("text", lines.drop_leading_headers("text")).withColumn("hash", text.content_hash("text"))
        known = spark.createDataFrame([], "filename string, __old string")
        if _existing(spark, register):
            earlier = spark.read.schema("filename string, hash string, batch bigint").parquet(register).where(F.col("batch") < batch_id)
            known = latest_versions(earlier, key=["filename"], version="batch").select("filename", F.col("hash").alias("__old"))
        label = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("hash"), "unchanged").otherwise("updated")
        labelled = checkpointed(good.join(known, "filename", "left").withColumn("label", label).drop("__old"))  # three writers read it
        changed = labelled.where("label <> 'unchanged'")
        labelled.select("filename", "hash", "label").write.mode("overwrite").parquet(f"{label_path}/batch={batch_id}")
        changed.select("filename", "text").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        changed.select("filename", "hash").write.mode("overwrite").parquet(f"{register}/batch={batch_id}")
    return write
