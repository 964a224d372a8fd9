import random

from pyspark.sql import functions as F

import __spark_entry__ as entry

from serialake.operators import filters, merging, ordering, registries, running, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(500), i, rng.randrange(3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, a int, i int, m int")


def test_running_sums_on_a_hot_key(spark):
    rows, df = hot_rows(spark)
    got = {(r["i"]): r["s"] for r in running.running_sums(df, key=["k"], order=["a", "i"], measures={"s": F.col("m")}, ranges=7).collect()}
    want, sums = {}, {}
    for k, a, i, m in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = want[i] = sums.get(k, 0) + m
    assert got == want


def test_hot_key_is_cut_into_several_ranges(spark):
    _, df = hot_rows(spark)
    cut = df.withColumn("r", running.range_of(df, ["k", "a", "i"], 8)).where("k = 'hot'").groupBy("r").count().collect()
    assert len(cut) >= 3 and max(r["count"] for r in cut) < 900


def test_previous_value_across_ranges(spark):
    rows, df = hot_rows(spark, 800)
    got = {r["i"]: r["p"] for r in running.previous_value(df, key=["k"], order=["a", "i"], value=F.col("i"), name="p", ranges=9).collect()}
    last, want = {}, {}
    for k, a, i, m in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], last[k] = last.get(k), i
    assert got == want


def test_keep_first_is_limited_before_the_shuffle(spark):
    _, df = hot_rows(spark, 100)
    first = ordering.keep_first(df, key=["k"], order=["a", "i"])
    assert plan(first).count("WindowGroupLimit") >= 1
    assert first.count() == df.select("k").distinct().count()


def paged(spark, rows):
    return spark.createDataFrame(rows, "g string, page int, pos int, url string")


def test_paging_stops_when_nothing_new(spark):
    growth = paged(spark, [("g", 1, 0, "a"), ("g", 2, 0, "b")])
    repeat = paged(spark, [("g", 1, 0, "a"), ("g", 2, 0, "a"), ("g", 3, 0, "c")])
    walk = dict(group="g", page="page", pos="pos", url="url")
    assert ordering.until_saturated(growth, **walk).count() == 2
    assert [tuple(r) for r in ordering.pages_walked(growth, **walk).collect()] == [("g", 2, 3, 2)]
    assert [r["url"] for r in ordering.until_saturated(repeat, **walk).collect()] == ["a"]
    assert [tuple(r) for r in ordering.pages_walked(repeat, **walk).collect()] == [("g", 1, 2, 1)]
    long = paged(spark, [("g", p, 0, f"u{p}") for p in range(1, 61)])
    assert [tuple(r) for r in ordering.pages_walked(long, **walk).collect()] == [("g", 60, 61, 60)]
    total = spark.createDataFrame([("g", 80)], "g string, total_pages int")
    assert [tuple(r) for r in ordering.pages_walked(long, announced=total, **walk).collect()] == [("g", 60, 61, 80)]


def test_short_page_ends_the_list(spark):
    pages = spark.createDataFrame([("a", 1, 75), ("a", 2, 74), ("a", 3, 75), ("b", 1, 75), ("b", 2, 0), ("c", 1, 75), ("c", 2, 75)], "g string, page int, n int")
    got = ordering.until_short_page(pages, group="g", page="page", new_items="n", page_size=75).groupBy("g").count().orderBy("g").collect()
    assert [(r["g"], r["count"]) for r in got] == [("a", 2), ("b", 1), ("c", 2)]
    capped = ordering.until_short_page(pages, group="g", page="page", new_items="n", page_size=75, expected=F.lit(70)).where("g = 'c'").count()
    assert capped == 1


def test_even_batches_match_ntile(spark):
    df = spark.range(8)
    sizes = ordering.even_batches(df, batches=3, order=["id"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2]
    assert {r["batch"] for r in ordering.even_batches(spark.range(2), batches=5, order=["id"]).collect()} == {1, 2}
    batches = ordering.fixed_batches(spark.range(5), size=2, order=["id"]).orderBy("id").collect()
    assert [r["batch"] for r in batches] == [1, 1, 2, 2, 3]


def test_request_ranges(spark):
    df = spark.createDataFrame([(280,), (0,)], "total int")
    rows = ordering.request_ranges(df, total="total").collect()
    assert [(r["from"], r["to"]) for r in rows if r["total"] == 280] == [(1, 100), (101, 200), (201, 280)]
    assert [(r["from"], r["to"]) for r in rows if r["total"] == 0] == [(None, None)]
    many = ordering.request_ranges(spark.createDataFrame([(12_000,)], "total int"), total="total").collect()
    assert len(many) == 120 and (many[-1]["from"], many[-1]["to"]) == (11_901, 12_000)


def test_request_ranges_of_one_file_are_made_in_many_tasks(spark, tmp_path):
    totals = spark.range(200).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"))
    totals.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    made = entry.queries()["g8_request_ranges"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert made.count() == 4 * sum(max(1, -(-k * 5 // 100)) for k in range(50))


def test_keep_largest_renames(spark):
    files = spark.createDataFrame([("w", 1, "0001_b.txt", 5), ("w", 1, "0001_a.txt", 9), ("w", 2, "0002_c.txt", 1)], "w string, i int, file string, size int")
    got = ordering.keep_largest(files, key=["w", "i"], size=F.col("size"), name="file", requested=F.format_string("%04d_new.txt", "i")).orderBy("i").collect()
    assert [(r["file"], r["size"]) for r in got] == [("0001_new.txt", 9), ("0002_new.txt", 1)]


SITES = [("a", "https://a.example"), ("b", "https://b.example")]


def test_source_merge(spark):
    sites = spark.createDataFrame(SITES, "site_key string, base_url string")
    rows = [("w", 1, 0, "https://b.example/1", None), ("w", 1, 1, " https://a.example/1 ", 5.0), ("w", 2, 0, "https://b.example/1", 7.0), ("w", 2, 1, "https://c.example/1", 1.0),
            ("w", 3, 0, "https://a.example/2", None), ("w", 4, 0, "https://a.example/1", 1.0), ("w", 4, 1, "", 1.0)]
    got = merging.merge_sources(spark.createDataFrame(rows, "work string, origin int, pos int, url string, priority double"), sites).orderBy("place").collect()
    assert [(r["url"], r["site_key"], r["priority"]) for r in got] == [("https://a.example/1", "a", 1.0), ("https://b.example/1", "b", 7.0), ("https://a.example/2", "a", None)]


def test_primary_source(spark):
    sites = spark.createDataFrame(SITES, "site_key string, base_url string")
    rows = [("w", 0, "https://a.example/1", "b"), ("w", 1, "https://b.example/1", "b"), ("w", 2, "https://b.example/1", None), ("w", 3, "https://a.example/9", None)]
    got = merging.primary_sources(spark.createDataFrame(rows, "work string, pos int, url string, site_key string"), sites).orderBy("pos").collect()
    assert [(r["url"], r["is_primary"], r["owner_key"]) for r in got] == [("https://b.example/1", True, "b"), ("https://a.example/9", False, "b")]


def test_change_labels_hash_clean_text(spark):
    from serialake.functions.lines import drop_leading_headers
    stored = spark.createDataFrame([(1, "A\nB"), (2, "A")], "k int, t string")
    incoming = spark.createDataFrame([(1, "Nguồn: x\nA\n\nB"), (2, "C"), (3, "N"), (4, None)], "k int, t string")
    got = merging.change_labels(stored, incoming, key=["k"], content="t", cleaned=drop_leading_headers("t")).orderBy("k").collect()
    assert [r["label"] for r in got] == ["unchanged", "updated", "new", "rejected"]


def test_content_types(spark):
    import pytest
    ok = spark.createDataFrame([(bytearray(b"new"),)], "b binary").select(merging.checked_content(F.col("b"))).first()[0]
    assert ok == "new"
    with pytest.raises(Exception, match="must not be null"):
        spark.createDataFrame([(None,)], "b binary").select(merging.checked_content(F.col("b"))).collect()


def test_upsert_rules(spark):
    stored = spark.createDataFrame([(1, "t", "x", "c0", "u0"), (2, "t2", "y", "c0", "u0")], "k int, title string, status string, created_at string, updated_at string")
    incoming = spark.createDataFrame([(1, "", "", ), (3, "new", None)], "k int, title string, status string")
    got = merging.upsert(stored, incoming, key=["k"], truthy=["title"], not_null=["status"], now=F.lit("now")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "t", "", "c0", "now", True), (2, "t2", "y", "c0", "u0", False), (3, "new", None, "now", "now", True)]


def test_category_append(spark):
    df = spark.sql("select array(named_struct('name','b','url','/b'), named_struct('name','A','url',cast(null as string))) c")
    got = df.select(merging.append_category(F.col("c"), name=F.lit("aa"), url=F.lit("/aa")).alias("x"), merging.append_category(F.col("c"), name=F.lit("z"), url=F.lit("/b")).alias("y")).first()
    assert [c["name"] for c in got["x"]] == ["A", "aa", "b"] and [c["name"] for c in got["y"]] == ["A", "b"]


def test_dead_counts_as_done_and_incomplete_is_reported(spark):
    works = spark.createDataFrame([("a", 1, 1, 2), ("b", 1, 0, 50), ("c", 0, 0, 5), ("d", 2, 0, None)], "w string, saved int, dead int, expected int")
    got = stats.completeness(works).orderBy("w").collect()
    assert [(r["complete"], r["report_missing"]) for r in got] == [(True, True), (False, True), (False, False), (False, False)]


def test_expected_total(spark):
    df = spark.createDataFrame([(10, 12), (None, 3), (0, 0), (None, None)], "s int, l int")
    assert [r[0] for r in df.select(stats.expected_total(stored=F.col("s"), live=F.col("l"))).collect()] == [12, 3, None, None]
    assert [r[0] for r in df.select(stats.expected_total(stored=F.col("s"), live=F.col("l"), limit=F.lit(5))).collect()] == [5, 5, 5, 5]


def test_retention_and_caps(spark):
    times = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-01 00:00:00",), ("soon",), (None,)], "t string")
    now = F.lit("2024-01-11 00:00:00").cast("timestamp")
    assert [r[0] for r in times.select(filters.is_recent("t", now=now)).collect()] == [True, False, True, False]
    df = spark.createDataFrame([(10, 8, None), (10, None, 0), (0, None, None)], "n int, t int, c int")
    limits = df.select(filters.effective_limit(listed="n", site_total="t", caller_cap="c", max_pages=1, per_page=0)).collect()
    assert [r[0] for r in limits] == [8, 0, 100]


def test_retry_cap_gives_permanent_missing(spark):
    tries = spark.createDataFrame([("p1", False), ("p2", False), ("p3", True)], "part string, ok boolean")
    got = stats.capped_failures(tries, key="part", failed=~F.col("ok"), cap=1).where("dead").orderBy("part").collect()
    assert [r["part"] for r in got] == ["p1", "p2"]


def test_registry_append(spark):
    old = spark.createDataFrame([("u1", 1)], "url string, n int")
    new = spark.createDataFrame([("u1", 5), ("u2", 3), ("u2", 2)], "url string, n int")
    assert sorted(tuple(r) for r in registries.append_unseen(old, new, key=["url"], order=["n"]).collect()) == [("u1", 1), ("u2", 2)]
