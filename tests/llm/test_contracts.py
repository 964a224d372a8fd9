"""The registered queries against brute force on whole small tables, planted edge cases among them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash

from serialake.llm import bpe, langid, mixing, queries, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """documents and labels of the smallest tables with nulls, blanks, repeats, a very long text and clashing extra columns."""
    folder = tmp_path_factory.mktemp("edge")
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs)
    long = " ".join(docs[0]["text"] for _ in range(400))
    texts = [None, "", "  \n\t ", "one", "one two", "123 !!! --", "日本語のテキスト", long, docs[1]["text"], docs[1]["text"] + " tail", "a'll  b\n\n c's \x00", "x" * 3000]
    docs += [{"doc_id": top + 1 + i, "text": t, "lang": None if i % 2 else "en", "source": None if i % 3 == 0 else "src1", "n_chars": 0} for i, t in enumerate(texts)]
    docs += [docs[2], docs[2], {"doc_id": None, "text": docs[3]["text"], "lang": "en", "source": "src0", "n_chars": None}]
    for d in docs:
        d |= {"shard": "x", "slot": 1, "size": "y", "score": None, "keep": 3, "lang_pred": "zz", "taken": 0, "a.b": 1}
    pq.write_table(pa.Table.from_pylist(docs), folder / "documents.parquet")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/labels.parquet"), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


def documents(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_sharding(spark, edge):
    rows = queries.op1_sharding(spark, edge).collect()
    docs = documents(edge)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d["doc_id"], size(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(24))


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_shards_are_near_equal(spark, folder):
    rows = queries.op1_sharding(spark, folder).collect()
    by = Counter()
    for r in rows:
        by[r.shard] += r["size"]
    whole, most = sum(by.values()), max(r["size"] for r in rows)
    assert len(by) == 24 and max(abs(b - whole / 24) for b in by.values()) <= 0.02 * whole / 24 + most
    split = defaultdict(set)
    for r in rows:
        split[r.text_crc32, r["size"]].add(r.shard)
    assert sum(len(s) - 1 for s in split.values()) <= 23


def test_media(spark, edge):
    rows = queries.op6_media(spark, edge).collect()
    want = []
    for d in documents(edge):
        raw = (d["text"] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        want.append((d["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert Counter(tuple(r)[:7] for r in rows) == Counter(want)
    same = defaultdict(set)
    for r in rows:
        same[r.payload_sha256].add(r.feature)
    assert all(len(f) == 1 and re.fullmatch("[0-9a-f]{16}", next(iter(f))) for f in same.values())


@pytest.mark.parametrize("folder", [SF, None])
def test_mixing(spark, edge, folder):
    folder = folder or edge
    rows, docs = queries.op7_mixing(spark, folder).collect(), documents(folder)
    sizes, names = Counter(), set()
    for d in docs:
        names.add(d["source"])
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    wanted = mixing.targets({n: sizes[n] for n in names})
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    source = {}
    for d in docs:
        source[d["doc_id"]] = d["source"]
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == wanted[s] and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - wanted[s]) <= 4 for s in wanted)
    again = queries.op7_mixing(spark, folder).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 187.5, "b": 75.0, None: 37.5})
    capped = mixing.targets({"a": 10, "b": 500, "c": 500})  # a stops at 30, b would take 2/3 of the rest
    assert capped == pytest.approx({"a": 30.0, "b": 980 * 2 / 3, "c": 980 / 3})
    assert mixing.targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0}


def library():
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("folder", [SF, None])
def test_bpe(spark, edge, folder):
    folder = folder or edge
    _, encoding = library()
    want = Counter()
    for d in documents(folder):
        ids = encoding.encode_ordinary(d["text"] or "")
        want[d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op9_bpe(spark, folder).collect()) == want


def test_bpe_of_odd_vocabularies():
    """Ranks no training would give, where a merge opens a pair of a lower rank."""
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {t: 256 + i for i, t in enumerate([b"abc", b"aab", b"ab", b"bc", b"aa", b"aaa", b"ca", b"cab"])}
    encoding = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 30))) for _ in range(500)]
    assert bpe.Merges(ranks).encode([w.encode() for w in words]) == [encoding.encode_ordinary(w) for w in words]


def test_bpe_round_trip(spark, edge):
    ranks = public_tokenizers.path(queries.RANKS)
    docs = spark.read.parquet(f"{edge}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    back = bpe.decode_ids(bpe.encode_texts(docs, ranks_path=ranks, pattern=public_tokenizers.PATTERN, with_digests=False), ranks_path=ranks)
    texts = {r.doc_id: r.text for r in back.collect()}
    assert texts == {d["doc_id"]: d["text"] or "" for d in documents(edge) if d["doc_id"] is not None}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("folder", [SF, None])
def test_simhash(spark, edge, folder):
    folder = folder or edge
    docs = [d for d in documents(folder)]
    prints = [fingerprint(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    want = Counter((d["doc_id"], f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip(docs, prints)))
    assert Counter(tuple(r) for r in queries.op10_simhash(spark, folder).collect()) == want


def test_simhash_shards_lose_no_link(spark):
    """Chains and balls of fingerprints at distances up to 3, dense clusters among them."""
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(0, 1 << 63, 300)]
    for centre in values[:20]:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            values.append(centre ^ sum(1 << int(b) for b in bits))
    array = np.unique(np.array(values, np.uint64))
    parent = list(range(len(array)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            parent[find(i)] = find(int(j))
    frame = spark.createDataFrame([(int(v),) for v in array.view(np.int64)], "fp bigint")
    linked = {r.fp: r.root for r in simhash.components(simhash.star_links(frame)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for i, v in enumerate(array.view(np.int64)):
        got[linked.get(int(v), int(v))].add(int(v))
        want[find(i)].add(int(v))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bk_forest_search():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 10, 400).astype(np.uint64))
    shards = np.sort(rng.integers(0, 3, len(fps)))
    forest = simhash.Forest(shards, fps)
    found = {(int(a), int(b)) for who, node in forest.search(np.arange(len(fps))) for a, b in zip(who, node)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if shards[i] == shards[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 3}
    assert found == want


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_id(spark, edge):
    truth = {d["doc_id"]: d["lang"] for d in documents(SF)}
    rows = queries.op2_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(own) > 0.99
    odd = {r.doc_id: r.lang_pred for r in queries.op2_language_id(spark, edge).collect()}
    assert all(odd[d["doc_id"]] == "und" for d in documents(edge) if d["text"] in (None, "", "  \n\t ", "123 !!! --"))
    assert sum(1 for _ in documents(edge)) == queries.op2_language_id(spark, edge).count()


def test_language_id_by_brute_force(spark):
    """Costs of one text worked out word by word from the model's tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    text = "The qzxthing of unseenthion über Wört"
    costs = []
    for word in ("the", "qzxthing", "of", "unseenthion", "über", "wört"):
        if word in model.words:
            costs.append(model.costs[model.words[word]])
            continue
        padded = f" {word} "
        for size in (4, 3, 2, 1):
            grams = [padded[i:i + size] for i in range(len(padded) - size + 1)]
            rows = [model.costs[model.grams[g]] for g in grams if g in model.grams]
            if rows:
                costs.append(np.mean(rows, axis=0))
                break
    mean = np.mean(costs, axis=0)
    (lang, score), = langid.Scorer(model)([text])
    assert lang == model.languages[int(mean.argmin())] and score == pytest.approx(1 / (10 ** (mean.min() - mean)).sum())


def test_toxicity(spark, edge):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = queries.op3_toxicity(spark, SF).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    own = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y, _ in own if y], [s for s, y, _ in own if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.95
    assert np.mean([p == y for _, y, p in own]) > 0.95
    assert queries.op3_toxicity(spark, edge).count() == len(documents(edge))
