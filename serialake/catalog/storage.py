"""A: sources and sinks, written to new folders and read back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.catalog.jobs import event_stream, messages
from serialake.catalog.registry import TASKS_A_CORE, Catalog
from serialake.catalog.scalars import FIRST_LINE, SLUG, STRIP_PREFIX
from serialake.functions import text
from serialake.rules import read_split_patterns
from serialake.sources import growing
from serialake.sources import jobs as job_io
from serialake.sources import tree, writers
from serialake.streaming import runs

catalog = Catalog()
q = catalog.query


# Characters that a partition folder holds as %XX, as Spark's own writer has them, and its name for a null.
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_tree(rows: DataFrame, root: str, folders: list[str], *, line: str, suffix: str) -> None:
    """One file per partition folder, ``a=1/b=x/part<suffix>``, as ``partitionBy`` lays them out, from many tasks and without a commit that
    moves every folder in turn; a repeated task writes the same files again."""
    def write(batches):
        store, top = growing._open(root)
        current, out, n = None, None, 0
        for batch in batches:
            for *values, value in zip(*[c.to_pylist() for c in batch.columns]):
                if values != current:
                    if out is not None:
                        out.close()
                    folder = "/".join([top, *[f"{f}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', v) if v else _NULL_FOLDER}" for f, v in zip(folders, values)]])
                    store.create_dir(folder, recursive=True)
                    current, out, n = values, store.open_output_stream(f"{folder}/part{suffix}"), n + 1
                out.write(f"{value or ''}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    named = rows.select(*[F.col(f).cast("string").alias(f) for f in folders], line).repartition(tasks, *folders).sortWithinPartitions(*folders)
    named.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


@q("a1_metadata_tree", """select 'w-' || s_suppkey as slug, s_name as title, case when s_acctbal > 5000 then 'genre ' || s_nationkey when s_nationkey > 10 then 'n' || s_nationkey else 'Unknown' end as genre,
    case when s_acctbal > 5000 then 'completed' else 'ongoing' end as state from supplier""")
def _(t):
    root = runs.work_folder(t.spark, "tree")
    cats = F.when(F.col("s_nationkey") > 10, F.array(F.struct(F.concat(F.lit("n"), "s_nationkey").alias("name"), F.lit(None).cast("string").alias("url"))))
    works = t.supplier.select(F.concat(F.lit("w-"), "s_suppkey").alias("slug"), F.col("s_name").alias("title"), cats.alias("categories"), "s_acctbal",
                              F.concat(F.lit("genre "), "s_nationkey").alias("genre"))
    stored = works.withColumn("json", F.to_json(F.struct("title", "categories")))
    write_tree(stored, f"{root}/open", ["slug"], line="json", suffix=".json")
    write_tree(stored.where("s_acctbal > 5000"), f"{root}/done", ["genre", "slug"], line="json", suffix=".json")
    found = tree.read_works(t.spark, f"{root}/open", f"{root}/done", file_glob="*.json")
    return found.select("slug", "title", "genre", "state")


_FILE_SQL = f"printf('%04d', turn + 1) || '_' || coalesce(nullif({SLUG.format(FIRST_LINE)}, ''), 'untitled')"


@q("a2_part_files", f"""select cast(conv_id as varchar) as work, file || '.txt' as file, turn + 1 as index, {STRIP_PREFIX.format("substr(file, 6)")} as title, text || chr(10) as text from (
    select conv_id, turn, text, printf('%04d', turn + 1) || '_part-' || role || '-' || turn as file from conversations)""")
def _(t):
    root = runs.work_folder(t.spark, "parts")
    name = F.concat(F.format_string("%04d", F.col("turn") + 1), F.lit("_part-"), "role", F.lit("-"), F.col("turn").cast("string"), F.lit(".txt"))
    write_tree(t.conversations.select(F.col("conv_id").alias("work"), name.alias("file"), "text"), root, ["work", "file"], line="text", suffix=".txt")
    return tree.read_parts(t.spark, root, pattern=r"work=([^/]+)/file=([^/]+)/").select("work", "file", "index", "title", "text")


@q("a3_owned_state", """select event_id from events where event_type in ('view', 'error')""")
def _(t):
    owner = F.when(F.col("event_type") == "view", "a").when(F.col("event_type") == "error", None).otherwise("b")
    return tree.owned_state(t.events.withColumn("site_key", owner), site_key="a").select("event_id")


@q("a4_pattern_files", """select p_partkey, regexp_matches(lower(p_name), 'ring|w.dg.t') as hit from part""")
def _(t):
    from serialake.functions.lines import matches_any
    folder = runs.work_folder(t.spark, "rules")
    # The rule file holds every distinct name fragment once: here the two the part names are tested for.
    rules = t.part.select(F.explode(F.array(F.lit("# comment"), F.lit(""), F.lit(" ring "), F.lit("w.dg.t"))).alias("value")).distinct()
    rules.write.text(folder)
    regexes, literals = read_split_patterns(t.spark, folder)
    return t.part.select("p_partkey", matches_any("p_name", [*regexes, *literals]).alias("hit"))


@q("a5_job_stream", "select count(*) as n, count(distinct event_id) as events from events")
def _(t):
    folder = runs.work_folder(t.spark, "messages")
    messages(t.events).select(F.to_json(F.struct("event_id", "value")).alias("value")).write.text(folder)
    stream = job_io.read_messages(t.spark, format="text", path=folder)
    landed = runs.run_available(stream, name="a5")
    return landed.agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("value", "$.event_id")).alias("events"))


@q("a6_job_payload", """select '{"type":"' || event_type || '","user_id":' || user_id || '}' as value from events""")
def _(t):
    return job_io.job_messages(t.events.select(F.col("event_type").alias("type"), "user_id"))


@q("a6_job_sink_stream", """select '{"type":"' || event_type || '","user_id":' || user_id || '}' as value from events""")
def _(t):
    payload = job_io.job_messages(event_stream(t).select(F.col("event_type").alias("type"), "user_id"))
    folder = runs.work_folder(t.spark, "sink")
    query = job_io.write_messages(payload, format="text", checkpoint=f"{folder}/checkpoint", path=f"{folder}/out")
    query.processAllAvailable()
    query.stop()
    return t.spark.read.text(f"{folder}/out")


def write_worker_logs(lines, folder: str) -> None:
    """Every partition writes its lines to a log file of its own, in the shared folder; a repeated task writes the same file again."""
    def write(batches):
        store, root = growing._open(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        own, staged, n = f"{root}/worker-{task.partitionId()}.log", f"{root}/_{task.taskAttemptId()}.tmp", 0
        with store.open_output_stream(staged) as out:
            for batch in batches:
                n += batch.num_rows
                out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        store.move(staged, own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["lines"])

    lines.mapInArrow(write, "lines bigint").agg(F.sum("lines")).collect()


@q("a7_log_tail_stream", "select doc_id, count(*) as lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by 1")
def _(t):
    folder, state = runs.work_folder(t.spark, "log"), runs.work_folder(t.spark, "a7")
    numbered = t.documents.select(F.posexplode(F.split("text", "\n")).alias("at", "line"), "doc_id").where("line <> ''")
    dealt = numbered.select((F.col("at") % 2).alias("later"), "at", "doc_id", F.concat("doc_id", F.lit("|"), "line").alias("line")).repartition(8, "doc_id").sortWithinPartitions("later", "doc_id", "at")
    # Half of the lines, then the same files with the other half behind it, under one checkpoint.
    for written in (dealt.where("later = 0"), dealt):
        write_worker_logs(written.select("line"), folder)
        tailed = runs.run_available(job_io.tail_log(t.spark, folder, glob="*.log").select("line"), name="a7", folder=state)
    return tailed.groupBy(F.regexp_extract("line", r"^([0-9]+)\|", 1).cast("bigint").alias("doc_id")).agg(F.count("*").alias("lines"))


@q("a8_versioned_write", "select o_orderkey, o_orderstatus, 2 as version from orders")
def _(t):
    root = runs.work_folder(t.spark, "versions")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    writers.write_version(rows.withColumn("version", F.lit(1)), root, "v1")
    writers.write_version(rows.withColumn("version", F.lit(2)), root, "v2")
    return writers.read_current(t.spark, root)


@q("a9_snapshot", "select snapshot_ts, count(*) as n from orders, (select unnest(['2024-01-01', '2024-01-02']) as snapshot_ts) group by 1")
def _(t):
    root = runs.work_folder(t.spark, "snapshots")
    for at in ("2024-01-01", "2024-01-02", "2024-01-02"):
        writers.snapshot(t.orders.select("o_orderkey"), root, at=at)
    return t.spark.read.schema("o_orderkey bigint, snapshot_ts string").parquet(root).groupBy("snapshot_ts").agg(F.count("*").alias("n"))


@q("a10_relocate_completed", "select o_orderkey, o_orderpriority as genre from orders where o_orderstatus = 'F'")
def _(t):
    root = runs.work_folder(t.spark, "completed")
    works = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("genre"), "o_orderstatus")
    nothing = works.limit(0).select("o_orderkey")
    complete = F.col("o_orderstatus") == "F"
    shape = "o_orderkey bigint, o_orderstatus string, status string, genre string"
    half = complete & (F.col("o_orderkey") % 2 == 0)
    # The first batch runs twice, the second finds what the first one moved.
    for batch, chosen in (("1", half), ("1", complete), ("2", complete)):
        stored = writers.read_batches(t.spark, root, shape).select("o_orderkey")
        writers.relocate_completed(works, stored.unionByName(nothing), root, key="o_orderkey", complete=chosen, batch=batch)
    return writers.read_batches(t.spark, root, shape).select("o_orderkey", "genre")


@q("a11_storable_metadata", "select o_orderkey, o_orderstatus from orders")
def _(t):
    works = t.orders.select("o_orderkey", "o_orderstatus", F.array(F.struct("o_custkey")).alias("chapters"))
    return writers.storable_metadata(works)


@q("a12_missing_report", "select 'Work ' || l_orderkey as title, 'w-' || l_orderkey as folder, max(l_linenumber) - count(distinct l_linenumber) as missing from lineitem group by l_orderkey having max(l_linenumber) > count(distinct l_linenumber)")
def _(t):
    folder = runs.work_folder(t.spark, "report")
    gaps = t.lineitem.groupBy("l_orderkey").agg((F.max("l_linenumber") - F.count_distinct("l_linenumber")).alias("missing")).where("missing > 0")
    for batch in ("1", "1"):
        writers.append_missing_report(gaps.select(F.concat(F.lit("Work "), "l_orderkey").alias("title"), F.concat(F.lit("w-"), "l_orderkey").alias("folder"), "missing"), folder, batch=batch)
    return writers.read_missing_report(t.spark, folder)
