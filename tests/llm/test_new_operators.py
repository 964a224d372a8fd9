"""Spelling variants, periodic runs and main text: brute force on whole small tables, planted edge cases among them."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from serialake.llm import main_text, queries, runs, variants

SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """documents and pages of the smallest tables with nulls, blanks, ties, repeats, very long values and clashing extra columns."""
    folder = tmp_path_factory.mktemp("edge")
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs)
    texts = [None, "", " \n\t ", "one", "la " * 30, "a b c " * 8 + "a b", "x " * 23, "x " * 24, "1 2 3 4 5 6 7 8 " * 3, "p q " * 20 + "p p q q " * 9,
             " ".join(docs[0]["text"] for _ in range(200)), "z" * 3000 + " " + "z" * 2999, " ".join(["colours color colors colour"] * 6), "éclaire éclairs " * 7,
             "ÀÀÀÀÀÀ àààààà àààààa × ×××××××", "日本語 " * 30, " ".join(["weather"] * 9), "whether whethers " * 3, "whether " * 200]
    docs += [{"doc_id": top + 1 + i, "text": t, "lang": None, "source": "s", "n_chars": 0} for i, t in enumerate(texts)]
    docs += [{"doc_id": 10 * i, "text": t * 3, "lang": "en", "source": None, "n_chars": 1} for i, t in enumerate(["tick tock " * 40, "red green blue " * 25])]
    docs += [docs[2], docs[2], {"doc_id": None, "text": docs[3]["text"] + " encore" * 40, "lang": "en", "source": "s", "n_chars": None}]
    for d in docs:
        d |= {"word": "w", "n": -1, "runs": "r", "key": None, "shard": 3, "root": 1, "Text_": 2}
    pq.write_table(pa.Table.from_pylist(docs), folder / "documents.parquet")
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    odd = [None, "", "   ", "plain text only", "<p>", "<<<>>><", "<article><p>" + "long words, many. " * 20000, "<div>" * 5000 + "deep, here." + "<div>x, y." * 5000, "<script>var a", "<!-- open",
           "<p a='\">&amp;&#x41;&#65;&bogus;&amp", "\x00\x01<b>", "<nav><a href=x>only links</a></nav>"]
    pages += [{"page_id": 10 ** 6 + i, "url": None if i % 2 else "http://x.y/", "html": t} for i, t in enumerate(odd)]
    pages += [pages[1], pages[1], {"page_id": None, "url": None, "html": pages[2]["html"]}]
    for p in pages:
        p |= {"text": "clash", "n_chars": "clash", "path": 1}
    pq.write_table(pa.Table.from_pylist(pages), folder / "pages.parquet")
    return str(folder)


def table(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


# -- spelling variants ------------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_words(docs, least_length=6, least_count=5, every=199):
    counts = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d['doc_id'] is None else d['doc_id']}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def expected_variants(counts, ratio=5):
    by_deletion = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_deletion[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for w in counts:  # candidates share a deletion, or one is a deletion of the other
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            near[w] |= by_deletion[less] | ({less} & counts.keys())
        near[w] |= by_deletion.get(w, set())
        near[w] = {v for v in near[w] if v != w and one_edit(v, w)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("folder", [SF, None])
def test_spelling(spark, edge, folder):
    folder = folder or edge
    rows = queries.op11_spelling(spark, folder)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in rows.collect()]
    want = expected_variants(expected_words(table(folder, "documents")))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in got)


@pytest.mark.parametrize("shard", [7, 40, 100_000])
def test_spelling_of_dense_words(spark, shard):
    """Few letters, so nearly every word has neighbours; small shards send many words to other shards; a third share a prefix."""
    dice = random.Random(4)
    words = {"".join(dice.choice("abé") for _ in range(dice.randint(1, 7))) for _ in range(300)}
    words |= {"shared" + "".join(dice.choice("xyz") for _ in range(dice.randint(0, 5))) for _ in range(150)}
    counts = {w: 5 ** dice.randint(0, 6) for w in words}
    frame = spark.createDataFrame([*counts.items(), (None, 4)], "word string, n bigint")
    got = [tuple(r) for r in variants.spelling_variants(frame, shard_words=shard).collect()]
    assert len(got) == len(counts) and set(got) == expected_variants(counts)
    chain = {w: f for w, f, *_ in got}
    assert any(chain[f] for f in chain.values() if f)  # a form of a form


def test_spelling_rejects_flat_ratio(spark):
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "word string, n bigint"), ratio=1)


# -- periodic runs ----------------------------------------------------------------------------------------------------

def brute_runs(words, least, times):
    out, size = [], len(words)
    for q in range(1, size // times + 1):
        i = 0
        while i + q < size:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < size and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k + r] for k in range(start, start + length - r)) for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_lyndon_groups_and_runs():
    dice = random.Random(7)
    for _ in range(400):
        words = [dice.randint(0, dice.choice([1, 2, 5])) for _ in range(dice.randint(1, 40))]
        size = len(words)
        length, group = runs.lyndon_groups(words)
        assert length == [next(j for j in range(i + 1, size + 1) if j == size or words[j:] < words[i:]) - i for i in range(size)]
        assert all((group[i] == group[j]) == (words[i:i + length[i]] == words[j:j + length[j]]) for i in range(size) for j in range(size))
        for least, times in ((2, 2), (5, 3), (12, 4)):
            assert runs.runs_of(np.array(words), least=least, times=times) == brute_runs(words, least, times)


def test_pieces_lose_no_run():
    dice = random.Random(8)
    for _ in range(150):
        texts = [[b"%d" % dice.randint(0, dice.choice([0, 1, 3, 50])) for _ in range(dice.randint(0, 60))] for _ in range(5)]
        texts = [x[:10] + x[10:10 + dice.randint(1, 6)] * dice.randint(1, 9) + x[20:] for x in texts]
        for least, times in ((24, 3), (6, 2), (9, 3)):
            assert runs.runs_of_texts(texts, least=least, times=times) == [brute_runs(x, least, times) for x in texts]


@pytest.mark.parametrize("folder", [SMALL, None])
def test_periodic_runs(spark, edge, folder):
    folder = folder or edge
    want = Counter()
    for d in table(folder, "documents"):
        words = periodic(d["doc_id"], d["text"])
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([number[w] for w in words], np.int64)
        found = []
        for q in range(1, len(ids) // 3 + 1):  # stretches of equality, whole arrays at a time; multiples of a shorter period go below
            same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
            edge_at = np.flatnonzero(np.diff(same))
            found += [(int(s), int(e - s + q), q) for s, e in zip(edge_at[::2], edge_at[1::2]) if e - s + q >= max(24, 3 * q)]
        found = sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        want[(d["doc_id"], len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
              hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    rows = queries.op12_periodic_runs(spark, folder)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, rows.collect())) == want


def test_periodic_runs_keep_text(spark):
    frame = spark.createDataFrame([(1, "go " * 30 + "home"), (2, "plain words here"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(frame).collect()}
    assert got[1].collapsed == "go home" and [tuple(r) for r in got[1].runs] == [(0, 30, 1)] and got[1].strongest == got[1].runs[0]
    assert got[2].collapsed == "plain words here" and got[2].runs == [] and got[2].strongest is None and got[3].collapsed == ""


# -- main text --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("folder", [SMALL, SF])
def test_main_text_of_the_tables(spark, folder):
    """Their pages mark the article, so its text can be cut out with patterns."""
    want = Counter()
    for p in table(folder, "pages"):
        inner = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        text = "\n".join(x for x in parts if x)
        want[p["page_id"], p["url"], text, len(text)] += 1
    assert Counter(map(tuple, queries.op13_main_text(spark, folder).collect())) == want


def test_main_text_edges(spark, edge):
    rows = queries.op13_main_text(spark, edge)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    got = rows.collect()
    assert len(got) == len(table(edge, "pages")) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert [by[10 ** 6 + i] for i in (0, 1, 2, 3, 4, 8, 9, 12)] == ["", "", "", "plain text only", "", "", "", ""]
    assert by[10 ** 6 + 6] == ("long words, many. " * 20000).strip()
    assert by[10 ** 6 + 7].count("x, y.") == 5000 and by[10 ** 6 + 7].startswith("deep, here.")


PROSE = "It was late, and the rain fell. Nobody came; the road, long and grey, lay still."
CHROME = """<header><a href="/">Site</a><p>Daily news, views, more.</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>"""
TAIL = """<aside><p>Read also, if you like: a long story, told in many, many words, by a stranger.</p></aside><footer>&copy; Site, 2020. All rights, all wrongs.</footer>"""


@pytest.mark.parametrize("page, want", [
    # article element; heading, list, table and caption come along
    (f"<body>{CHROME}<article><header><h1>Head</h1></header><p>{PROSE}</p><ul><li>first</li><li>second</li></ul><table><tr><td>1</td><td>2</td></tr></table>"
     f"<figure><img src=x><figcaption>Cap</figcaption></figure><p>{PROSE}</p></article>{TAIL}</body>", ["Head", PROSE, "first", "second", "1", "2", "Cap", PROSE]),
    # no article element: paths alone decide, comments and sidebars are named
    (f"<body>{CHROME}<div id=wrap><div class=content><h1>Head</h1><p>{PROSE}</p><p>short.</p><blockquote><p>{PROSE}</p></blockquote></div>"
     f"<div class='sidebar-left'><p>{PROSE}</p></div><div id=comments><div class=comment><p>{PROSE}</p></div></div></div>{TAIL}</body>", ["Head", PROSE, "short.", PROSE]),
    # notices, adverts, forms, hidden parts inside the article
    (f"<body><div class='cookie-notice'><p>{PROSE}</p></div><main><h1>Head</h1><div class=ad>{PROSE}</div><p>{PROSE}</p><form><p>{PROSE}</p><input></form>"
     f"<p hidden>{PROSE}</p><div style='display: none'>{PROSE}</div></main><script>if (a < b) '</p>'</script><style>p{{}}</style></body>", ["Head", PROSE]),
    # comments as articles, an article in unclosed navigation, a class that tells about the page
    (f"<body class=has-sidebar><nav><ul><li><a href=/>Home</a><article class=post><h1>Head</h1><p>{PROSE}</article>"
     f"<section class=comments><article class=comment><p>{PROSE}</p></article></section></body>", ["Head", PROSE]),
    # white space, references, inline markup, line breaks
    ("<article><p>a\n\t b&nbsp;c &lt;d&gt; <b>e</b>f<br>g &eacute;&#33;</p></article>", ["a b c <d> ef g é!"]),
    # unlabelled link lists fall, a paragraph with a link stays
    (f"<body><div><ul><li><a href=a>One thing</a></li><li><a href=b>Other thing</a></li></ul></div><div><h1>Head</h1><p>{PROSE} <a href=x>More</a>.</p></div></body>",
     ["Head", f"{PROSE} More."]),
])
def test_main_text_layouts(page, want):
    assert main_text.article_of(page).split("\n") == want


def test_path_smoothing_by_brute_force():
    dice = random.Random(3)
    paths = {tuple(dice.choice("abc") for _ in range(dice.randint(0, 5))): dice.random() for _ in range(60)}

    def steps(a, b):
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return len(a) + len(b) - 2 * shared

    for path, value in main_text.smoothed(paths).items():
        weights = {other: main_text.DECAY ** steps(path, other) for other in paths}
        assert value == pytest.approx(sum(weights[o] * paths[o] for o in paths) / sum(weights.values()))
