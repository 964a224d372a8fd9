import datetime as dt
import json
import random
import tracemalloc
from functools import partial

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serialake.catalog import storage
from serialake.sources import jobs as job_io
from serialake.operators import plugins
from serialake.sources import growing, tree, writers
from serialake.streaming import jobs, ordered, runs, stateful, timers


def test_metadata_tree(spark, tmp_path):
    def put(path, text):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    put(tmp_path / "open/a-work/metadata.json", json.dumps({"title": "A", "categories": [{"name": "G", "url": None}]}, indent=2))
    put(tmp_path / "open/b-work/metadata.json", json.dumps({"title": "B", "rating_value": 4.5}))
    put(tmp_path / "open/c-work/metadata.json", json.dumps({"title": "C"}))
    put(tmp_path / "open/broken/metadata.json", "{ not json")
    put(tmp_path / "done/Tiên Hiệp/c-work/metadata.json", json.dumps({"title": "C done"}))
    got = tree.read_works(spark, str(tmp_path / "open"), str(tmp_path / "done")).orderBy("slug").collect()
    assert [(r["slug"], r["title"], r["genre"], r["state"], r["rating_value"]) for r in got] == [
        ("a-work", "A", "G", "ongoing", None), ("b-work", "B", "Unknown", "ongoing", "4.5"), ("c-work", "C done", "Tiên Hiệp", "completed", None)]


def test_trees_are_laid_out_as_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "1%/x", "one"), ("a b", "1%/x", "two"), (None, "y=é", None), ("c", "", "z")], "w string, f string, text string").repartition(1)
    rows.write.partitionBy("w", "f").text(str(tmp_path / "spark"))
    storage.write_tree(rows, str(tmp_path / "own"), ["w", "f"], line="text", suffix=".txt")

    def tree_of(root):
        return {str(f.parent.relative_to(root)): sorted(f.read_text(encoding="utf-8").splitlines()) for f in root.rglob("*.txt")}

    assert tree_of(tmp_path / "own") == tree_of(tmp_path / "spark")


def test_part_files(spark, tmp_path):
    folder = tmp_path / "w1"
    folder.mkdir()
    (folder / "0001_chuong 1 dau.txt").write_text("x", encoding="utf-8")
    (folder / "12.rest.txt").write_text("é", encoding="utf-8")
    (folder / "0003_empty.txt").write_text("", encoding="utf-8")
    (folder / "note.md").write_text("no", encoding="utf-8")
    got = tree.read_parts(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["work"], r["file"], r["index"], r["title"], r["size_bytes"]) for r in got] == [("w1", "0001_chuong 1 dau.txt", 1, "dau", 1), ("w1", "12.rest.txt", 12, "rest", 2)]


def test_state_owner(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"site_key": "a", "globally_completed_story_urls": ["u"]}), encoding="utf-8")
    assert tree.read_state(spark, str(path), site_key="a").count() == 1
    assert tree.read_state(spark, str(path), site_key="b").count() == 0
    assert tree.read_state(spark, str(tmp_path / "none.json"), site_key="a").count() == 0


def test_version_swap_and_partition_overwrite(spark, tmp_path):
    root = str(tmp_path / "v")
    for n in (1, 2):
        writers.write_version(spark.range(n), root, f"v{n}")
    assert writers.read_current(spark, root).count() == 2
    path = str(tmp_path / "p")
    writers.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "g string, n int"), path, ["g"])
    writers.overwrite_partitions(spark.createDataFrame([("b", 2)], "g string, n int"), path, ["g"])
    assert sorted((r["g"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_payload_acceptance(spark):
    df = spark.createDataFrame([(None,), ("{}",), ("[1]",), ('{"type": "x"}',), ("x",)], "value string")
    assert [r[0] for r in df.select(job_io.is_acceptable(F.col("value"))).collect()] == [False, False, False, True, False]
    rows = spark.createDataFrame([(None, None), ("a", None)], "type string, title string")
    assert [r["value"] for r in job_io.job_messages(rows).collect()] == ['{"type":"a"}']


def test_routing(spark):
    messages = ['{"type":"single_story","title":"T"}', '{"type":"single_story"}', '{"type":"nope"}', "{}", "{", '{"type":"retry_chapter","site_key":"s","chapter_url":"u","chapter_title":"c","story_title":"t","filename":"f"}',
                '{"type":"missing_check"}']
    got = jobs.parse_jobs(spark.createDataFrame([(m,) for m in messages], "value string")).collect()
    assert [(r["route"], r["rejected"]) for r in got] == [("single_story", None), ("rejected", "missing_field"), ("rejected", "unknown_type"), ("rejected", "missing_type"),
                                                           ("rejected", "bad_json"), ("retry_chapter", None), ("missing_check", None)]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream(spark, folder, batches, schema):
    """One parquet folder per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_failure_machine_keeps_state_between_batches(spark, tmp_path):
    batches = [[("hot", at(i)) for i in range(5)] + [("a", at(0))], [("a", at(9)), ("hot", at(7))], [("a", at(20)), ("a", at(30)), ("b", at(1))]]
    got = runs.run_available(stateful.dead_keys(stream(spark, tmp_path / "s", batches, "k string, ts timestamp"), key="k", time="ts", cap=3), name="t").collect()
    assert sorted((r["k"], r["ts"], r["failures"]) for r in got) == [("a", at(20), 3), ("hot", at(2), 3)]


def ordered_rows(spark, sink, source, key_type="string"):
    runs.run_batches(source, sink, name="t")
    return sink.emitted(spark, T.StringType() if key_type == "string" else T.LongType()).collect()


def test_ban_alert_resets(spark, tmp_path):
    batches = [[("p", at(i)) for i in range(9)], [("p", at(10)), ("p", at(11)), (None, at(11)), ("q", None)], [("p", at(12 + i)) for i in range(8)] + [("p", at(500))]]
    sink = ordered.alert_sink(str(tmp_path / "out"), pool="pool", time="ts")
    got = ordered_rows(spark, sink, stream(spark, tmp_path / "s", batches, "pool string, ts timestamp"))
    assert sorted((r["ts"], r["n"]) for r in got) == [(at(10), 10)]


def test_ban_events(spark, tmp_path):
    """Cooldowns by gap and by watermark, the last member of a pool stays, exempt keys are never banned, a banned key is not usable again."""
    rows = [[("p", "a", at(i)) for i in (0, 10, 200)] + [("p", "b", at(i)) for i in (1, 2, 3)] + [("q", "x", at(i)) for i in (0, 1, 2)],
            [("p", "c", at(300 + i)) for i in (1, 2, 3)] + [("p", "b", at(350)), ("r", "z", at(400)), ("q", "y", at(400)), ("p", "free", at(401)), ("p", "free", at(402)), ("p", "free", at(403))],
            [("r", "z", at(1000))]]
    pools = spark.createDataFrame([("p", 3), ("q", 1)], "pool string, size int")
    source = stream(spark, tmp_path / "s", rows, "pool string, k string, ts timestamp")
    exempt = F.when(F.col("k") == "free", True)  # unknown for all others
    got = runs.run_available(timers.ban_events(source, pools, key="k", pool="pool", time="ts", exempt=exempt), name="t").collect()
    assert sorted((r["ts"], r["k"], r["event"]) for r in got) == [
        (at(3), "b", "ban"), (at(62), "x", "usable"), (at(70), "a", "usable"), (at(200), "a", "ban"), (at(363), "c", "usable"), (at(460), "y", "usable"), (at(460), "z", "usable"),
        (at(463), "free", "usable")]
    bans = runs.run_available(timers.ban_events(source, pools, key="k", pool="pool", time="ts"), name="t").where("event = 'ban'").select("pool", "ts")
    bans.write.parquet(str(tmp_path / "bans"))  # the ban stream feeds the alert
    sink = ordered.alert_sink(str(tmp_path / "alerts"), pool="pool", time="ts", seconds=300, threshold=2)
    assert [(r["ts"], r["n"]) for r in ordered_rows(spark, sink, spark.readStream.schema(bans.schema).parquet(str(tmp_path / "bans")))] == [(at(200), 2)]


def test_merged_failures_keep_what_counts():
    """The combiner may merge failures of one cooldown, not the first ones and not across a free cooldown."""
    times = [0, 1, 2, 3, 4, 50, 51, 200, 201, 202]
    pdf = pd.DataFrame({"pool": "p", "key": "k", "first": times, "last": times}).sample(frac=1, random_state=1)
    out, = timers.merge_failures(["pool", "key"], 3, 60)(iter([pdf]))
    assert list(zip(out["first"], out["last"])) == [(0, 0), (1, 1), (2, 2), (3, 51), (200, 202)]


def test_retry_rounds_equal_the_batch_at_any_clock(spark, tmp_path):
    dice = random.Random(9)
    rows = [(dice.choice("abcdef"), at(dice.randrange(0, 20_000)), dice.random() < 0.2) for _ in range(160)]
    rows = sorted({(k, t): ok for k, t, ok in rows}.items(), key=lambda r: r[0][1])
    rows = [(k, t, ok) for (k, t), ok in rows]
    for n, clock in enumerate((4_000, 11_500, 40_000)):
        now = at(clock)
        known = [r for r in rows if r[1] <= now] + [("clock", now, True)]
        cut = len(known) // 2
        source = stream(spark, tmp_path / f"s{n}", [known[:cut], known[cut:]], "k string, ts timestamp, ok boolean")
        emitted = runs.run_available(timers.retry_rounds(source, key="k", time="ts", ok=F.col("ok")), name="t").collect()
        last = {k: max(r[1] for r in known if r[0] == k) for k, *_ in known}
        current = {(r["k"], r["attempt"], r["round"], r["delay"], r["next_retry_at"]) for r in emitted if r["last_failure"] == last[r["k"]]}
        table = spark.createDataFrame(known, "k string, ts timestamp, ok boolean")
        due = jobs.due_retries(table.where("not ok"), table.where("ok"), key="k", time="ts", now=F.lit(now).cast("timestamp")).collect()
        assert current == {(r["k"], r["attempt"], r["round"], r["delay"], r["next_retry_at"]) for r in due} and (n == 0 or len(due) > 2)


def test_trailing_count_excludes_the_edge(spark):
    df = spark.createDataFrame([("p", at(0)), ("p", at(59)), ("p", at(60)), ("q", at(60))], "pool string, ts timestamp")
    got = stateful.trailing_counts(df, time="ts", seconds=60, pool="pool").orderBy("pool", "ts").collect()
    assert [r["recent"] for r in got] == [1, 2, 2, 1]


def test_trailing_counts_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["p", "q", None]), at(rng.choice([0, 60, 61, 120, rng.randrange(400)])), i) for i in range(300)] + [("p", None, 300)]
    got = stateful.trailing_counts(spark.createDataFrame(rows, "pool string, ts timestamp, i int"), time="ts", seconds=60, pool="pool").collect()
    timed = [r for r in rows if r[1] is not None]
    assert {r["i"]: r["recent"] for r in got} == {i: sum(p == q and dt.timedelta(0) <= t - u < dt.timedelta(seconds=60) for q, u, _ in timed) for p, t, i in timed}


def test_trailing_counts_of_a_full_block_are_a_running_sum(spark):
    # A frame that moves at both ends is read again for every row: 120,000 rows of one block would be billions of steps.
    rows = spark.range(120_000).select(F.timestamp_micros(F.col("id") * 300).alias("ts"), "id")
    got = stateful.trailing_counts(rows, time="ts", seconds=60)
    assert "unboundedpreceding" in got._jdf.queryExecution().analyzed().toString().lower()
    assert got.agg(F.sum("recent")).first()[0] == 120_000 * 120_001 // 2


def test_a_page_becomes_text_once_for_all_its_jobs(spark):
    asked = spark.createDataFrame([(f"{n}.txt", f"u{n % 3}", "c", "s", "x", None) for n in range(30)], "filename string, chapter_url string, chapter_title string, story_title string, site string, site_key string")
    landed = spark.createDataFrame([(i, f"u{i}", html) for i, html in enumerate(["<article>one</article>", None])], "page_id bigint, url string, html string")
    results = jobs.retry_results(asked, landed)
    plan = results._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.index("Join LeftOuter") < plan.index("AS __body")
    assert {(r["chapter_url"], r["outcome"], (r["text"] or "")[-3:]) for r in results.collect()} == {("u0", "ok", "one"), ("u1", "not_landed", ""), ("u2", "not_landed", "")}
    assert results.count() == 30


def test_ban_exemptions(spark):
    df = spark.createDataFrame([("a", at(i), i, "p") for i in range(4)] + [("b", at(i), i, "p") for i in range(2)] + [("x", at(i), i, "p") for i in range(3)] + [("y", at(9 + i), i, "p") for i in range(3)]
                               + [("one", at(i), i, "q") for i in range(3)], "k string, ts timestamp, i int, pool string")
    spared = F.when(F.col("k") == "x", True)  # null for the others: no exemption
    bans = stateful.bans_batch(df.where("pool = 'p'"), key="k", time="ts", tie="i", exempt=spared)
    assert sorted((r["k"], r["ts"]) for r in bans.collect()) == [("a", at(2)), ("y", at(11))]
    pools = spark.createDataFrame([("p", 2), ("q", 1)], "pool string, size int")
    assert [(r["k"], r["ts"]) for r in stateful.bans_batch(df, key="k", time="ts", tie="i", pools=pools, exempt=spared).collect()] == [("a", at(2))]


def test_debounce_compares_with_last_emitted(spark, tmp_path):
    batches = [[("k", at(0)), ("k", at(1.5)), ("k", at(2.5))], [("k", at(3)), ("k", at(4.5))]]
    sink = ordered.debounce_sink(str(tmp_path / "out"), key="k", time="ts", seconds=2)
    got = ordered_rows(spark, sink, stream(spark, tmp_path / "s", batches, "k string, ts timestamp"))
    assert sorted(r["ts"] for r in got) == [at(0), at(2.5), at(4.5)]


def test_repeats_pass_again_after_their_time(spark, tmp_path):
    rows = [("k", at(0)), ("k", at(200)), ("k", at(1000)), ("k", at(1200)), ("k", at(5000))]
    for n, batches in enumerate(([rows], [rows[:1], rows[1:4], rows[4:]], [[r] for r in rows])):
        sink = ordered.suppress_sink(str(tmp_path / f"out{n}"), key="k", time="ts", seconds=300)
        got = ordered_rows(spark, sink, stream(spark, tmp_path / f"s{n}", batches, "k string, ts timestamp"))
        assert sorted(r["ts"] for r in got) == [at(0), at(1000), at(5000)]


def test_ordered_state_expires_and_replays(spark, tmp_path):
    """Keys whose time is over leave the state; a batch written twice changes nothing."""
    sink = ordered.suppress_sink(str(tmp_path / "out"), key="k", time="ts", seconds=300)
    schema = "k bigint, ts timestamp"
    sink(spark.createDataFrame([(i, at(i)) for i in range(50)], schema).coalesce(1), 0)
    assert sink.states(spark, T.LongType(), 0).count() == 50
    late = spark.createDataFrame([(1000, at(10_000)), (3, at(10_000))], schema)
    for _ in range(2):
        sink(late, 1)
    assert sorted(r["key"] for r in sink.states(spark, T.LongType(), 1).collect()) == [3, 1000]
    assert sink.emitted(spark, T.LongType()).count() == 52


def test_hot_key_in_constant_memory():
    """A million rows of one key pass through a machine that keeps a few times."""
    def batches():
        for start in range(0, 1_000_000, 10_000):
            times = list(range(start * 1000, (start + 10_000) * 1000, 1000))
            yield pa.RecordBatch.from_arrays([pa.array(["hot"] * 10_000), pa.array([False] * 10_000), pa.array([None] * 10_000, pa.list_(pa.int64())), pa.array(times, pa.int64())],
                                             ["key", "old", "kept", "at"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in ordered._walk(partial(ordered.debounced, 2500), 0, pa.string(), batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 333_334 + 1 and peak < 40e6


def test_retries_never_give_up(spark):
    rows = [("often", at(i)) for i in range(20)] + [("again", at(0)), ("again", at(9000)), ("fixed", at(0))]
    failures = spark.createDataFrame(rows, "k string, ts timestamp")
    done = spark.createDataFrame([("again", at(10)), ("fixed", at(10))], "k string, ts timestamp")
    due = jobs.due_retries(failures, done, key="k", time="ts", now=F.lit(at(90_000)).cast("timestamp")).collect()
    assert {r["k"]: (r["attempt"], r["round"], r["delay"]) for r in due} == {"often": (20, 5, 1800), "again": (1, 1, 10)}


def test_retry_sink_is_idempotent(spark, tmp_path):
    store, labels = str(tmp_path / "store"), str(tmp_path / "labels")
    write = jobs.retry_sink(store, labels)
    first = spark.createDataFrame([("f1", "ok", "A"), ("f2", "anti_bot", None)], "filename string, outcome string, text string")
    second = spark.createDataFrame([("f1", "ok", "A"), ("f3", "ok", "C")], "filename string, outcome string, text string")
    for batch_id, batch in ((0, first), (0, first), (1, second), (1, second)):
        write(batch, batch_id)
    rows = spark.read.parquet(labels).orderBy("batch", "filename").collect()
    assert [(r["batch"], r["filename"], r["label"]) for r in rows] == [(0, "f1", "new"), (1, "f1", "unchanged"), (1, "f3", "new")]
    assert spark.read.parquet(store).count() == 2


def test_log_tail_drops_old_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("[WARNING] Sau crawl bù, truyện 'X' vẫn thiếu chương: 1+0/3\nother\n", encoding="utf-8")
    fresh = runs.run_available(jobs.warning_jobs(job_io.tail_log(spark, str(tmp_path), since="2000-01-01 00:00:00")), name="t").collect()
    assert [(r["story_title"], r["total_count"]) for r in fresh] == [("X", 3)]
    assert runs.run_available(job_io.tail_log(spark, str(tmp_path), since="2100-01-01 00:00:00").select("line"), name="t").count() == 0


def test_growing_log(spark, tmp_path):
    """Appends, an unfinished line, a rotation, a truncation and a restart per step: every line once."""
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    log, other = logs / "app.log", logs / "other.log"

    def tail(**options):
        rows = runs.run_available(job_io.tail_log(spark, str(logs), glob="*.log*", **options), name="t", folder=state).collect()
        assert len({(r["file"], r["position"], r["line"]) for r in rows}) == len(rows)
        return sorted(r["line"] for r in rows)

    seen = ["app 1", "app 2", "other 1 é"]
    log.write_text("app 1\napp 2\napp 3 unfini", encoding="utf-8")
    other.write_text("other 1 é\r\n", encoding="utf-8")
    assert tail() == sorted(seen)
    with log.open("a", encoding="utf-8") as f:  # the line is finished, more follow
        f.write("shed\napp 4\n")
    seen += ["app 3 unfinished", "app 4"]
    assert tail(split_bytes=7) == sorted(seen)
    with log.open("a", encoding="utf-8") as f:  # written, then rotated away, and a new file begun
        f.write("app 5\n")
    log.rename(logs / "app.log.1")
    log.write_text("new 1\n", encoding="utf-8")
    seen += ["app 5", "new 1"]
    assert tail() == sorted(seen)
    (logs / "app.log.2").write_bytes((logs / "app.log.1").read_bytes())  # copied on, then truncated and refilled
    (logs / "app.log.1").write_text("fresh 1\nfresh 2\n", encoding="utf-8")
    other.write_text("", encoding="utf-8")
    seen += ["fresh 1", "fresh 2"]
    assert tail() == sorted(seen)
    assert tail() == sorted(seen)
    other.unlink()
    log.write_text("new 1\nnew 2\n", encoding="utf-8")
    assert tail() == sorted([*seen, "new 2"])


def test_growing_log_in_pieces(tmp_path):
    """Any cut of an addition into pieces gives the same lines at the same places."""
    text = b"".join(b"%d %s\n" % (i, b"x" * (i * 7 % 50)) for i in range(400)) + b"\n\nlast\n"
    (tmp_path / "a.log").write_bytes(text + b"open")
    lines = text.decode().split("\n")[:-1]
    for split in (1, 5, 64, 4096, 1 << 20):
        reader = growing.GrowingLogReader({"path": str(tmp_path), "splitBytes": str(split)})
        got = [row for piece in reader.partitions({"files": []}, reader.latestOffset()) for batch in reader.read(piece) for row in zip(*(c.to_pylist() for c in batch.columns))]
        assert [r[0] for r in got] == lines and all(text[p:].startswith(line.encode() + b"\n") for line, _, p in got)
    late = growing.GrowingLogReader({"path": str(tmp_path), "startingOffsets": "latest"})
    assert growing.additions(late.initialOffset()["files"], late.latestOffset()["files"]) == []


def test_retry_takes_the_latest_landing(spark, tmp_path):
    rows = [(1, "u1", "<article><p>old</p></article>", 5), (2, "u1", "<article><p>new</p></article>", 9), (3, "u1", "<article><p>older</p></article>", 1), (4, None, "x", 1), (5, "u2", "", 1)]
    landed = spark.createDataFrame(rows, "page_id bigint, url string, html string, at int")
    asked = spark.createDataFrame([(f"f{u}", u) for u in ("u1", "u2", "u3")], "filename string, chapter_url string").selectExpr(
        "*", "'s' as site", "cast(null as string) as site_key", "'c' as chapter_title", "'t' as story_title")
    for by, body in (("at", "new"), (None, "older")):
        got = {r["filename"]: (r["outcome"], (r["text"] or "").rsplit("\n", 1)[-1]) for r in jobs.retry_results(asked, landed, landed=by).collect()}
        assert got == {"fu1": ("ok", body), "fu2": ("not_landed", ""), "fu3": ("not_landed", "")}
    write = jobs.retry_sink(str(tmp_path / "store"), str(tmp_path / "labels"))
    for batch_id, words in ((0, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "a")):
        write(spark.createDataFrame([("f", "ok", words)], "filename string, outcome string, text string"), batch_id)
    assert [r["label"] for r in spark.read.parquet(str(tmp_path / "labels")).orderBy("batch").collect()] == ["new", "unchanged", "updated", "updated"]


def test_batches_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "k bigint, g string"
    assert writers.read_batches(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "x"), (2, "y")], schema)
    assert [writers.append_batch(rows, path, batch=b, by=["g"]) for b in ("1", "1", "2")] == [True, False, True]
    rows.write.parquet(f"{path}/batch=3")  # a run that broke off before its manifest entry
    assert sorted((r["k"], r["g"], r["batch"]) for r in writers.read_batches(spark, path, schema).collect()) == [(1, "x", "1"), (1, "x", "2"), (2, "y", "1"), (2, "y", "2")]
    assert writers.append_batch(rows.where("k = 1"), path, batch="3", by=["g"]) and writers.read_batches(spark, path, schema).where("batch = 3").count() == 1
    report = str(tmp_path / "r")
    for batch in ("a", "a", "b"):
        writers.append_missing_report(spark.createDataFrame([("T", "f", 3)], "title string, folder string, missing bigint"), report, batch=batch)
    assert [tuple(r) for r in writers.read_missing_report(spark, report).collect()] == [("T", "f", 3)] * 2


def test_site_extractors(spark):
    frame = spark.createDataFrame([(1, "a", "<p>x</p>"), (2, "b", "<p>y</p>"), (3, None, "z"), (4, "c", "w"), (5, "a", None)], "page_id bigint, site_key string, html string")

    def lengths(batch):
        yield pa.RecordBatch.from_arrays([pa.array([len(h or "") for h in batch.column("html").to_pylist()], pa.int64()), batch.column("page_id")], ["n", "page_id"])

    def broken(batch):
        return pa.RecordBatch.from_arrays([batch.column("page_id")], ["page_id"])
    got = plugins.extract_by_site(frame, {"a": lengths, "b": lengths}, "page_id bigint, n int").collect()
    assert sorted(map(tuple, got)) == [(1, 8), (2, 8), (5, 0)]
    with pytest.raises(Exception, match="extractor of b"):
        plugins.extract_by_site(frame, {"b": broken}, "page_id bigint, n int").collect()


def test_skip_list(spark, tmp_path):
    (tmp_path / "skipped.json").write_text(json.dumps({"a-work": {"url": "u", "title": "A", "reason": "dead"}, "b": {}}, indent=1), encoding="utf-8")
    got = tree.read_skipped_works(spark, str(tmp_path / "skipped.json")).collect()
    assert sorted((r["slug"], r["url"], r["title"], r["time"], r["reason"]) for r in got) == [("a-work", "u", "A", None, "dead"), ("b", None, None, None, None)]
