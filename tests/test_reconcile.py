import random
from collections import Counter

from pyspark.sql import functions as F

from serialake.operators import reconcile

PARTS = "work string, pos bigint, index bigint, title string, url string, file string"
SAVED = "work string, file string, size bigint"
DEAD = "work string, index bigint, url string"


def parts(spark, rows):
    return spark.createDataFrame(rows, PARTS)


def missing(spark, canonical, listed, saved, dead=()):
    out = reconcile.missing_parts(parts(spark, canonical), parts(spark, listed), spark.createDataFrame(saved, SAVED), spark.createDataFrame(list(dead), DEAD))
    return [r["index"] for r in out.orderBy("index").collect()]


def plain(n, start=1, prefix="/c/"):
    return [("w", i, start + i, f"Chương {start + i}: T{chr(65 + i)}", f"{prefix}{start + i}", None) for i in range(n)]


def test_missing_plain(spark):
    assert missing(spark, plain(4), plain(4), [("w", "0001_a.txt", 9), ("w", "0003_c.txt", 9)], [("w", 4, "/c/4")]) == [2]


def test_missing_absent_at_source(spark):
    listed = [plain(3)[0], plain(3)[2]]
    assert missing(spark, plain(3), listed, [("w", "0001_a.txt", 9), ("w", "0003_c.txt", 9)]) == []


def test_offset_alignment(spark):
    canonical = [("w", i, i + 1, t, f"/c/{i}", None) for i, t in enumerate(["Start", "Middle", "End"])]
    listed = [("w", i, i + 2, t, f"/s/{i}", None) for i, t in enumerate(["Start", "Middle", "End"])]
    saved = [("w", "0001_start.txt", 5), ("w", "0002_middle.txt", 5)]
    offsets = reconcile.numbering_offsets(parts(spark, canonical), parts(spark, listed), spark.createDataFrame(saved, SAVED))
    assert [(r["offset"], r["skip"]) for r in offsets.collect()] == [(-1, False)]
    assert missing(spark, canonical, listed, saved) == [3]
    aligned = reconcile.align_listed(parts(spark, listed), offsets)
    assert [r["aligned"] for r in aligned.orderBy("pos").collect()] == [1, 2, 3]


def test_inconsistent_source_is_skipped(spark):
    canonical = [("w", 0, 1, "Mở đầu", "/c/1", None)]
    listed = [("w", 0, 1, "Other", "/s/1", None), ("w", 1, 2, "Else", "/s/2", None)]
    assert missing(spark, canonical, listed, [("w", "0001_x.txt", 5)]) == []
    assert missing(spark, canonical, [("w", 0, 1, "Other", "/c/1", None)], []) == [1]


def test_stored_file_marks_number_for_later_rows(spark):
    canonical = [("w", 0, 5, "A", "/1", None), ("w", 1, 5, "B", "/2", "right-name.txt"), ("w", 2, 5, "C", "/3", None)]
    assert missing(spark, canonical, canonical, [("w", "right-name.txt", 5)]) == [5]
    assert missing(spark, canonical, canonical, [("w", "right-name.txt", 0)]) == [5, 5, 5]


def brute(canonical, listed):
    by_key: dict = {}
    for _, _, index, title, _, _ in canonical:
        by_key.setdefault(title.lower(), set()).add(index)
    return Counter(c - row[2] for row in listed for c in by_key.get(row[3].lower(), ()))


def test_repeated_titles_match_brute_force(spark):
    rng = random.Random(3)
    canonical = [("hot", i, n, "same", None, None) for i, n in enumerate(rng.sample(range(1, 4000), 300))] + [("w", i, i + 1, f"t {chr(97 + i)}", None, None) for i in range(9)]
    listed = [("hot", i, rng.randrange(1, 4000), "Same", None, None) for i in range(400)] + [("w", i, i + 3, f"t {chr(97 + i)}", None, None) for i in range(9)]
    out = {r["work"]: r for r in reconcile.numbering_offsets(parts(spark, canonical), parts(spark, listed), spark.createDataFrame([], SAVED)).collect()}
    want = brute([c for c in canonical if c[0] == "hot"], [r for r in listed if r[0] == "hot"])
    ranked = sorted(want.items(), key=lambda kv: (-kv[1], abs(kv[0]), kv[0]))
    assert (out["hot"]["offset"], out["hot"]["best"], out["hot"]["second"], out["hot"]["total"]) == (ranked[0][0], ranked[0][1], ranked[1][1], sum(want.values()))
    assert (out["w"]["offset"], out["w"]["best"], out["w"]["skip"]) == (-2, 9, False)


def expected_offsets(canonical, listed, saved):
    """Work by work: count every pair, rank, judge."""
    out = {}
    for work in {c[0] for c in canonical}:
        counts = brute([c for c in canonical if c[0] == work], [r for r in listed if r[0] == work])
        ranked = sorted(counts.items(), key=lambda kv: (-kv[1], abs(kv[0]), kv[0]))
        titles = {c[3].lower() for c in canonical if c[0] == work}
        matched = sum(r[0] == work and r[3].lower() in titles for r in listed)
        (offset, best), second, total = ranked[0] if ranked else (0, 0), ranked[1][1] if len(ranked) > 1 else 0, sum(counts.values())
        sure = bool(ranked) and (best >= 3 or best / total >= 0.6 or matched <= 2) and not (offset != 0 and second and best - second <= 1)
        out[work] = (offset, best, second, total, matched, not sure and any(w == work and file[0].isdigit() for w, file, _ in saved))
    return out


def test_offsets_of_any_repetition_match_brute_force(spark):
    """Runs, gaps, strides, repeated rows, far apart numbers and several works, against all pairs."""
    rng = random.Random(5)
    canonical, listed, saved = [], [], [("w1", "0001_x.txt", 1), ("w4", "7.txt", 1), ("w5", "notes.txt", 1)]
    for w in range(8):
        far = [0, 0, 10**6, 0, 10**13, 0, 70_000, 0][w]
        for i in range(rng.randrange(1, 60)):
            number = i * rng.choice([1, 1, 2]) + 1 if w % 2 else rng.randrange(1, 40) + far * rng.randrange(2)
            canonical.append((f"w{w}", i, number, rng.choice(["a", "a", "b", "c"]), None, None))
        for i in range(rng.randrange(0, 80)):
            listed.append((f"w{w}", i, rng.randrange(1, 50) + far * rng.randrange(3), rng.choice(["A", "B", "x"]), None, None))
    got = {r["work"]: tuple(r)[1:] for r in reconcile.numbering_offsets(parts(spark, canonical), parts(spark, listed), spark.createDataFrame(saved, SAVED)).collect()}
    assert got == expected_offsets(canonical, listed, saved)


def test_one_title_through_a_whole_work(spark):
    """A work of 100,000 parts of one name, listed two numbers on: two steps a side, not ten thousand million pairs."""
    canonical = spark.range(100_000).selectExpr("'w' as work", "id as pos", "id + 1 as index", "'Extra' as title", "cast(null as string) as url", "cast(null as string) as file")
    listed = canonical.withColumn("index", F.col("index") + 2)
    row, = reconcile.numbering_offsets(canonical, listed, spark.createDataFrame([("w", "0001_x.txt", 1)], SAVED)).collect()
    assert (row["offset"], row["best"], row["second"], row["total"], row["match_count"], row["skip"]) == (-2, 100_000, 99_999, 10**10, 100_000, True)


def test_huge_numbers_do_not_stop_the_job(spark):
    canonical = [("w", i, i + 1, t, f"/c/{i}", None) for i, t in enumerate(["Start", "Middle", "End"])] + [("w", 3, None, "Chapter 9223372036854775807", None, None)]
    listed = [("w", i, i, t, f"/s/{i}", None) for i, t in enumerate(["Start", "Middle", "End"])] + [("w", 3, None, "Chapter 9223372036854775807", "/s/9", None)]
    offsets = reconcile.numbering_offsets(parts(spark, canonical), parts(spark, listed), spark.createDataFrame([], SAVED))
    assert [r["offset"] for r in offsets.collect()] == [1]
    assert [r["aligned"] for r in reconcile.align_listed(parts(spark, listed), offsets).orderBy("pos").collect()] == [1, 2, 3, 2**63 - 1]
    assert missing(spark, canonical, listed, [("w", "0001_x.txt", 1)]) == [2, 3, 2**63 - 1]


def test_expected_and_misnamed_files(spark):
    works = spark.createDataFrame([("w", 3)], "work string, total int")
    titles = spark.createDataFrame([("w", 0, "a/b"), ("w", 2, "c")], "work string, pos int, title string")
    expected = reconcile.expected_files(works, titles, work="work", total="total")
    assert sorted(r["file"] for r in expected.collect()) == ["0001_a_b.txt", "0002_untitled.txt", "0003_c.txt"]
    actual = spark.createDataFrame([("w", "0003_c.txt"), ("w", "0001_old.txt")], "work string, file string")
    assert sorted(r["file"] for r in reconcile.absent_files(expected, actual, work="work").collect()) == ["0001_a_b.txt", "0002_untitled.txt"]
    named = expected.withColumn("index", F.col("pos") + 1)
    assert [(r["old_file"], r["new_file"]) for r in reconcile.misnamed_files(named, actual).collect()] == [("0001_old.txt", "0001_a_b.txt")]


def test_result_does_not_depend_on_partitions(spark):
    args = (plain(40), plain(40)[::2], [("w", f"{i:04d}_x.txt", 3) for i in range(1, 40, 3)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = missing(spark, *args)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert missing(spark, *args) == one != []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
