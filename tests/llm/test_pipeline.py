"""The stages of the corpus pipeline, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from serialake.llm import langid, mixing, quality, queries, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The DataFrame before and after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == list(corpus_pipeline.DOCUMENT) for s in stages[1:-1])


def test_language(spark, stages):
    before, after = stages[0], stages[1]
    model = langid.fit(before)
    least = corpus_pipeline.least_score(len(model.languages))
    found = {r.doc_id: r for r in langid.identify(before, model).collect()}
    want = {i: r.lang_pred for i, r in found.items() if r.lang_pred != "und" and r.score >= least}
    assert {r.doc_id: r.lang for r in after.collect()} == want and len(want) >= 0.99 * before.count()


def test_unknown_script_with_two_languages(spark):
    words = {"en": "the house stands near the river and the road", "de": "das haus steht an dem fluss und der strasse"}
    rows = [(i, words[lang], lang, "s", 0) for i, lang in enumerate(["en", "de"] * 3)] + [(11, "\u4f60\u597d \u4e16\u754c", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.language(spark, docs, SF)
    assert sorted((r.doc_id, r.lang) for r in after.collect()) == [(i, lang) for i, lang in enumerate(["en", "de"] * 3)]
    assert [round(corpus_pipeline.least_score(n), 3) for n in (1, 2, 4, 100)] == [1.0, 0.533, 0.3, 0.076]


def test_quality(spark, stages):
    before, after = stages[1], stages[2]
    kept = {r.doc_id for r in quality.judged(before, queries.trusted_ids(spark, SF)).where("keep").collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect() if r.doc_id in kept)
    assert 0 < after.count() < before.count()


def test_near_duplicates(stages):
    before, after = stages[2], stages[3]
    groups = defaultdict(set)
    for r in simhash.near_duplicates(before).collect():
        groups[r.component_id].add(r.doc_id)
    assert Counter(r.doc_id for r in after.collect()) == Counter(groups.keys()) == Counter(min(g) for g in groups.values())


def test_mixing(stages):
    before, after = stages[3], stages[4]
    size = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
    source = {r.doc_id: r.source for r in before.collect()}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    for r in after.collect():
        taken[source[r.doc_id]] += size[r.doc_id]
    wanted = mixing.targets(sizes)
    most = max(size.values())
    assert all(abs(taken[s] - wanted[s]) <= most for s in wanted)


def test_tokens(stages):
    before, after = stages[4], stages[5]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())
    assert after.where("size(ids) != n_tokens or ids_sha256 is null").count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(5, "same words in this text", "en", "a", 1)] * 3 + [(None, "same words in this text", "en", "a", 1), (None, "other words are in here", "en", "b", 1), (7, None, "en", "b", 1), (8, "", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id or -1, r.text or "") for r in simhash.keep_one(docs).collect()) == [(-1, "other words are in here"), (5, "same words in this text"), (7, "")]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)] if words else [])


def overlap_groups(texts):
    """Brute force: the smallest place in the component of each text over overlaps of 0.8 or more."""
    sets, parent, having = list(map(shingle_set, texts)), list(range(len(texts))), defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s or {b""} for j in having[x])
        for j, n in common.items():
            if n >= 0.8 * len(s | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
        for x in s or {b""}:
            having[x].append(i)
    return [find(i) for i in range(len(texts))]


def test_near_copies_of_the_tables_are_those_of_brute_force(spark, stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect())
    want = {i: rows[g][0] for (i, _), g in zip(rows, overlap_groups([t for _, t in rows]))}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(stages[2]).collect()} == want
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(want.values()))


def test_near_copies_between_08_and_095_leave_one(spark):
    """150 pairs with replaced words, 150 pairs just below 0.8, one group of 200 copies of one text."""
    rng = np.random.default_rng(8)
    fresh = iter(range(10**9))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]

    def changed(text, n, gap=5):
        out = list(text)
        for at in rng.choice(len(text) // gap - 1, n, replace=False):
            out[2 + gap * int(at)] = words(1)[0]
        return out

    base = [words(204) for _ in range(300)]
    near = [changed(t, int(rng.integers(1, 5))) for t in base[:150]]     # 200 shingles, 3 to 5 of them changed by each word: 0.81 to 0.98
    below = [changed(t, 7) for t in base[150:]]                          # about 0.7
    group = words(1004)
    hot = [group] + [changed(group, 16, 25) for _ in range(199)]         # each about 0.85 with the first, below 0.8 with most others
    texts = [" ".join(t) for t in base + near + below + hot]
    want = overlap_groups(texts)
    assert len(set(want)) == 300 + 150 + 1
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(want))


def test_groups_of_several_blocks_are_those_of_brute_force(spark, monkeypatch):
    """Blocks of 8 members: copies that hang together, a family mostly below 0.8, chains whose ends are far apart."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)

    def changed(text, n):
        out = list(text)
        for at in rng.choice(len(text) // 5 - 1, n, replace=False):
            out[2 + 5 * int(at)] = f"v{rng.integers(1 << 60)}"
        return out

    texts = []
    for changes, count in ((1, 60), (3, 60), (4, 40)):
        base = [f"b{rng.integers(1 << 60)}" for _ in range(154)]
        texts += [changed(base, changes) for _ in range(count)]
    chain = [f"c{rng.integers(1 << 60)}" for _ in range(154)]
    for _ in range(40):
        chain = changed(chain, 2)
        texts.append(chain)
    order = rng.permutation(len(texts))
    texts = [" ".join(texts[i]) for i in order]
    want = overlap_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(want)) and len(set(want)) > 30


def test_contracted_links_are_components(spark):
    """Chains in order and out of order, loops, repeated links."""
    links = [(i + 1, i) for i in range(40)] + [(100 + i * 37 % 41, 100 + (i + 1) * 37 % 41) for i in range(40)] * 2 + [(7, 7), (500, 500), (-3, -9)]
    found = {r.fp: r.root for r in simhash.contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(41)}, -3: -9, -9: -9}
    assert simhash.contracted(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_contracted_links_by_rounds_and_in_one_task(spark, monkeypatch, most):
    """The rounds alone, a few rounds before the last task, the last task alone."""
    monkeypatch.setattr(simhash, "LAST_LINKS", most)
    rng = np.random.default_rng(5)
    links = rng.integers(-60, 60, (70, 2)).tolist()
    parent = {v: v for link in links for v in link if link[0] != link[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    found = [tuple(r) for r in simhash.contracted(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == sorted(parent.items()) and len(set(parent.values())) > 5


def test_contracting_few_links_takes_few_jobs(spark):
    """A chain in random order, which rounds of joins shorten step by step: each is jobs that the driver holds."""
    order = np.random.default_rng(6).permutation(300).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    spark.sparkContext.setJobGroup("contracted", "")
    try:
        found = simhash.contracted(links).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.fp: r.root for r in found} == dict.fromkeys(range(300), 0)
    assert 1 <= len(spark.sparkContext.statusTracker().getJobIdsForGroup("contracted")) <= 8


def test_bucket_stars_are_the_components_of_all_pairs():
    rng = np.random.default_rng(4)
    buckets, fps = [], []
    for b, size in enumerate(rng.integers(1, 30, 60)):
        seed = rng.integers(0, 1 << 63, (3, 2), dtype=np.uint64)
        for _ in range(size):
            fp = seed[rng.integers(3)].copy()
            for bit in rng.integers(0, 128, rng.integers(0, 30)):
                fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            buckets.append(b)
            fps.append(fp)
    buckets, fps = np.array(buckets), np.array(fps)
    want = np.arange(len(buckets))
    near = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= simhash.NEAR) & (buckets[:, None] == buckets[None])
    for _ in range(len(buckets)):
        want = np.where(near, want[None, :], len(buckets)).min(axis=1)
    assert (simhash.bucket_stars(buckets, fps, frontier=50) == want).all() and len(set(want)) > 60


def test_keep_one_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 4, 5, 6), (3, "other words", 1, 2, 3)], "doc_id bigint, text string, own_id int, PLACE int, k_hash int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e f", 7, 8, 9), (3, "other words", 1, 2, 3)]


def test_stages_of_empty_and_null_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert simhash.keep_one(spark.createDataFrame([], schema)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, schema)
    assert simhash.keep_one(nulls).count() == 1
