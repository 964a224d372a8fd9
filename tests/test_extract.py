import pyarrow as pa
from pyspark.sql import functions as F

from serialake import rules
from serialake.catalog.registry import Tables
from serialake.materialise import checkpointed as chains_checkpointed
from serialake.operators import chains, extract, nodes
from serialake.plans import cleaning
from serialake.rules import Rule

URL = "https://h.example/list"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, URL, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_genre_links_clean_names_and_fall_back(spark):
    html = "<nav><a href='/the-loai/tien-hiep'> Tiên Hiệp <i>2115</i></a><a href='/THE-LOAI/x'>no</a><a href='/the-loai/Tien-Hiep'>again</a></nav><a href='/the-loai/z'>late</a>"
    fallback = "<div><a href='https://o.example/the-loai/y'>Y</a></div>"
    rows = extract.link_inventory(pages(spark, html, fallback), rules.CATALOG_GENRES).orderBy("page_id").collect()
    assert [(r["page_id"], r["name"], r["url"]) for r in rows] == [(0, "Tiên Hiệp", "https://h.example/the-loai/tien-hiep"), (1, "Y", "https://o.example/the-loai/y")]


def test_listing_link_prefers_score(spark):
    html = ("<a href='/tong-hop?ctg=1&rank=2'>a</a><a href='/tong-hop?ctg=1&tp=cv'>b</a><a href='/tong-hop?ctg=1&tp=cv&ord=new'>c</a><a href='/tong-hop?tp=cv'>d</a>")
    weights = [("href", "tp=cv", 3), ("text", "xem thêm", 2), ("href", "rank=|time=", -1), ("href", "ord=", -1)]
    got = extract.listing_link(pages(spark, html, "<p></p>"), required=["/tong-hop", "ctg="], weights=weights).collect()
    assert [(r["page_id"], r["score"], r["url"]) for r in got] == [(0, 3, "https://h.example/tong-hop?ctg=1&tp=cv")]


CARD = ("<div class='book-wrap'><h3><a class='name' href='/doc-truyen/{0}'>Work {0}</a></h3><p class='chapter'><a class='section' href='/doc-truyen/{0}/chuong-{1}'>Chương {1}</a></p>"
        "<p class='author'><a class='writer' href='/t/{0}'>Author {0}</a></p></div>")


def test_card_listing(spark):
    html = "<div class='update-list'>" + CARD.format("a", 12) + CARD.format("b", 45) + CARD.format("a", 12) + "</div>"
    rows = extract.listing_rows(pages(spark, html), rules.CATALOG_LISTING).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["latest_part"], r["author"]) for r in rows] == [
        ("Work a", "https://h.example/doc-truyen/a", "Chương 12", "Author a"), ("Work b", "https://h.example/doc-truyen/b", "Chương 45", "Author b")]
    assert rows[0]["latest_part_url"] == "https://h.example/doc-truyen/a/chuong-12"


def test_listing_falls_back_to_any_work_link(spark):
    html = "<section><div><a href='/doc-truyen/a/chuong-1'>Chương 1</a><a href='/doc-truyen/a'>Work a</a></div></section>"
    rows = extract.listing_rows(pages(spark, html), rules.CATALOG_LISTING).collect()
    assert [(r["title"], r["url"]) for r in rows] == []  # the first link of the container is a part
    rows = extract.listing_rows(pages(spark, html.replace("Chương 1</a>", "").replace("<a href='/doc-truyen/a/chuong-1'>", "")), rules.CATALOG_LISTING).collect()
    assert [(r["title"], r["url"]) for r in rows] == [("Work a", "https://h.example/doc-truyen/a")]



def test_listing_title_attribute_of_cut_texts(spark):
    html = "<div class='popular-item-wrap'><h5 class='widget-title'><a href='/a' title='Full long name'>Full lo...</a></h5></div>"
    titles = [extract.listing_rows(pages(spark, html), rules.READER_LISTING, attribute_first=first).first()["title"] for first in (True, False)]
    assert titles == ["Full long name", "Full lo..."]


def test_part_list_with_unquoted_links(spark):
    html = "".join(f"<li class='wp-manga-chapter '>\n<a href=https://h.example/t/chuong-{n}/>Chương {n} &nbsp;Tên</a>\n</li>" for n in (1, 2, 3))
    rows = extract.part_list(pages(spark, html), rules.READER_PARTS, detect_newest_first=True).orderBy("pos").collect()
    assert [(r["title"], r["url"]) for r in rows] == [(f"Chương {n} Tên", f"https://h.example/t/chuong-{n}/") for n in (1, 2, 3)]


def test_part_list_order_and_skips(spark):
    item = "<li><a href='/c{0}'>{1}</a></li>"
    newest = "<ul class='version-chap'>" + item.format(3, "Chapter 3") + "<li><a href='javascript:void(0)'>x</a></li>" + item.format(1, "Chapter 1") + "</ul>"
    unnumbered = "<ul class='version-chap'>" + item.format(1, "Two") + item.format(2, "One") + "</ul>"
    paged = "<ul><li><a href='/c1'>A</a></li></ul><ul class='pagination'><li><a href='/p2'>2</a></li></ul>"
    got = extract.part_list(pages(spark, newest, unnumbered), rules.READER_PARTS, detect_newest_first=True).orderBy("page_id", "pos").collect()
    assert [r["title"] for r in got] == ["Chapter 1", "Chapter 3", "One", "Two"]
    assert [r["title"] for r in extract.part_list(pages(spark, paged), rules.CATALOG_PARTS).collect()] == ["A"]


def test_detail_record(spark):
    html = ("<html><meta name='book_detail' content=' 42 '><div class='book-info'><h1>Tên - ??</h1><p class='intro'>a</p><p class='intro'> b </p></div><div class='book-img'><img src='/c.jpg'></div>"
            "<p class='tag'><a class='blue'>Tác Giả</a><span class='blue'>Full</span><a class='red' href='/g/1'>G1</a><a class='red' href='/G/1'>dup</a><a class='red' href='/g/2'>G2</a></p>"
            "<a id='j-bookCatalogPage'>Mục lục (1.234 chương)</a><span class='ULtwOOTH-view'>5.000</span><a class='tags'>t1</a>"
            "<script type='application/ld+json'>{\"aggregateRating\": {\"ratingValue\": 4.5, \"reviewCount\": 9}}</script></html>")
    r = extract.work_detail(pages(spark, html), rules.CATALOG_DETAIL, source=F.lit("s")).first()
    assert (r["title"], r["author"], r["status"], r["description"], r["cover"]) == ("Tên", "Tác Giả", "Full", "a b", "https://h.example/c.jpg")
    assert [(c["name"], c["url"]) for c in r["categories"]] == [("G1", "https://h.example/g/1"), ("G2", "https://h.example/g/2")]
    assert (r["total_parts"], r["work_id"], r["stats"], r["tags"], r["rating_value"], r["rating_count"]) == (1234, "42", {"views": 5000}, ["t1"], "4.5", "9")


def test_ranges(spark):
    groups = [f"Chương {a} - {a + 99}" for a in (1, 101)] + ["Chương 101 - 200", "280 - 201", "x", "7"]
    df = spark.createDataFrame([(1, groups)], "id int, labels array<string>")
    rows = extract.part_ranges(df, labels=F.col("labels"), keep=["id"]).orderBy("pos").collect()
    assert [(r["from"], r["to"]) for r in rows] == [(1, 100), (101, 200), (201, 280), (7, 7)]
    raw = spark.createDataFrame([(1, [("9", "5"), ("1", None), ("x", "2")])], "id int, r array<struct<from:string,to:string>>")
    assert [(x["from"], x["to"]) for x in raw.select(extract.sorted_ranges(F.col("r")).alias("r")).first()["r"]] == [(1, 1), (5, 9)]


def test_content_chain_and_noise(spark):
    html = "<div class='chapter-c-content'><div class='panel-box'>no</div><div class='box-chap'>Một\nHai</div><script>no</script><div class='box-chap'>&lt;Ba&gt;</div></div>"
    other = "<div id='chapter-content'>X<br>Y</div>"
    rows = extract.main_content(pages(spark, html, other, "<p></p>"), rules.CATALOG_CONTENT, rules.CATALOG_CONTENT_NOISE).orderBy("page_id").collect()
    assert [r["content"] for r in rows] == ["<p>Một</p><p>Hai</p><p>&lt;Ba&gt;</p>", "<p>X</p><p>Y</p>", None]


def test_latest_parts_of_named_section(spark):
    block = "<div class='volume-wrap'><div class='volume'><h3>{}</h3><ul><li><a href='/{}'>P</a></li></ul></div></div>"
    html = block.format("Mục lục", "a") + block.format("CHƯƠNG MỚI NHẤT", "b") + block.format("chương mới nhất", "c")
    assert [r["url"] for r in extract.latest_parts(pages(spark, html), rules.LATEST_PARTS, phrase="chương mới nhất").collect()] == ["https://h.example/b"]


def test_profiles_expire_and_apply(spark):
    row = lambda age: [("H.example", 1000 - age, 1, ".item", "a.l", "h4", None, "?p={n}", None, None)]
    html = "<div class='item'><h4>T</h4><a class='l' href='/x'>L</a></div><div class='item'><a class='l' href='/y' title='tt'></a></div><div class='item'><a class='l' href='/z'></a></div>"
    live = extract.live_profiles(pages(spark, html), spark.createDataFrame(row(0), rules.PROFILE_SCHEMA), now=F.lit(1000))
    rows = extract.profile_listing(live, rules=rules.profile_rules()).orderBy("pos").collect()
    assert [(r["title"], r["url"]) for r in rows] == [("T", "/x"), ("tt", "/y"), ("untitled", "/z")]
    assert extract.live_profiles(pages(spark, html), spark.createDataFrame(row(3601), rules.PROFILE_SCHEMA), now=F.lit(1000)).count() == 0
    assert extract.live_profiles(pages(spark, html), spark.createDataFrame(row(3600), rules.PROFILE_SCHEMA), now=F.lit(1000)).count() == 1


def test_cleaning_by_rules_and_quarantine(spark):
    body = "<div id='chapter-content'><p>Nguồn: x</p><p>Một dòng dài</p><div class='ads'>quá dài để giữ</div><p>Menu</p></div>"
    kept, aside = cleaning.quarantine(cleaning.clean_pages_by_rules(pages(spark, body, "<p>none</p>", "<div id='chapter-c'><p>menu</p></div>"), []))
    assert [r["text"] for r in kept.collect()] == ["Một dòng dài"]
    assert sorted((r["page_id"], r["reason"]) for r in aside.collect()) == [(1, "no_container"), (2, "empty_after_cleaning")]


def test_plugin_runs_on_arrow_batches(spark):
    def count_links(batches):
        import pyarrow as pa
        for batch in batches:
            html = batch.column("html").to_pylist()
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "links": pa.array([h.count("<a") for h in html], pa.int64())})
    got = nodes.plugin(pages(spark, "<a><a>", "<p>"), count_links, "page_id bigint, links bigint").collect()
    assert sorted((r["page_id"], r["links"]) for r in got) == [(0, 2), (1, 0)]


def test_pattern_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# comment\n\n^a.b\n  Fan Page \n", encoding="utf-8")
    assert rules.read_split_patterns(spark, str(tmp_path / "p.txt")) == (["^a.b"], ["fan page"])


def test_direct_child_selector(spark):
    html = "<ul class='v'><li data-value='1'><a class='c'>1-2</a></li><div><li data-value='2'><a class='c'>3</a></li></div></ul>"
    found = pages(spark, html).select(nodes.find_elements(F.col("html"), [Rule("r", "ul.v > li[data-value] a.c")]).alias("f")).first()["f"]
    assert [e["text"] for e in found] == ["1-2"]


def test_selectors_shared_by_rules_are_tested_once(monkeypatch):
    tested, matches = [], nodes._matches
    monkeypatch.setattr(nodes, "_matches", lambda stack, index, chain, step=0: tested.append(chain) or matches(stack, index, chain, step))
    many = [Rule(f"f{i}", "a[href]", i, "div.x", i) for i in range(30)] + [Rule("g", "li.never")]
    found = nodes.walk("<div class='x'><p>1</p><a href='/y'>2</a></div>", nodes.plain_rules(many), ("script", "style"))
    assert [e["field"] for e in found] == [f"f{i}" for i in range(30)] and len(tested) == 2


def test_elements_are_made_in_slices(spark):
    assert [len(s) for s in nodes.slices(pa.array(range(150)))] == [64, 64, 22]
    htmls = [None, *[f"<p>{i}</p>" for i in range(1, 150)]]
    made = nodes._walked(lambda page: nodes.walk(page, (("p", "p", 0, None, 0),), ()), pa.array(htmls))
    assert [[e["text"] for e in page] for page in made.to_pylist()] == [[], *[[str(i)] for i in range(1, 150)]]
    assert nodes._walked(lambda page: [], pa.array([], pa.string())).to_pylist() == []
    found = pages(spark, *htmls).select("page_id", nodes.find_elements(F.col("html"), [Rule("p", "p")])["text"].alias("t"))
    assert {r["page_id"]: r["t"] for r in found.collect()} == {0: [], **{i: [str(i)] for i in range(1, 150)}}


def test_short_rows_of_much_work_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spread = Tables(spark, str(tmp_path)).spread("customer", "id")
    assert spread.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and spread.count() == 100


READER = """<html><body class="single postid-77"><div class="post-title"><h1> A  Title </h1></div>
<div class="post-content_item"><div class="summary-heading"><h3>Tác giả</h3></div><div class="summary-content"><div>Nobody</div></div></div>
<div class="post-content_item"><div class="summary-heading"><h3> Trạng thái </h3></div><div class="summary-content"><div>Hoàn <b>thành</b></div></div></div>
<div class="author-content"><a>Au</a></div><div class="description-summary"><div class="summary__content"><p>One <i>x</i></p><script>no</script><p>Two</p></div></div>
<div class="genres-content"><a href="/g/1">G1</a><a href="/g/2">G2</a></div><div class="summary_image"><img src="/c.jpg"></div>{0}</body></html>"""
GROUPS = ("<ul class='main version-chap'><li class='has-child' data-value='1-100'><a class='has-child' href='#'>Chương 100 - 1</a><ul><li class='wp-manga-chapter'><a href='/c/1'>x</a></li></ul></li>"
          "<li class='has-child' data-value='101-200'><a class='has-child'>mới</a></li><li class='has-child' data-value='101-200'></li><li class='has-child' data-value='5'>201 → 280</li></ul>")


def test_second_layout_detail_and_ranges(spark):
    frame = pages(spark, READER.format(GROUPS), READER.format("<ul class='main version-chap' data-last='chuong-12'></ul>"), READER.format(""))
    got = extract.work_detail(frame, rules.READER_DETAIL, status_heading=rules.READER_STATUS_HEADING, description_separator="\n").orderBy("page_id").collect()
    assert [r["total_parts"] for r in got] == [280, 12, None]
    row = got[0]
    assert (row["title"], row["author"], row["status"], row["description"], row["cover"], row["work_id"]) == ("A Title", "Au", "Hoàn thành", "One\nx\nTwo", "https://h.example/c.jpg", "77")
    assert [c["name"] for c in row["categories"]] == ["G1", "G2"]
    ranges = extract.page_ranges(frame, rules.READER_RANGES).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["from"], r["to"]) for r in ranges] == [(0, 1, 100), (0, 101, 200), (0, 201, 280)]


def packed(body):
    import base64
    import zlib
    return base64.b64encode(zlib.compress(body.encode())).decode()


def test_reader_content(spark):
    ads = "<div class='ads'>Buy <div>now</div></div><div><p>listen</p><a href='/hdsd/xaudio.php'>audio</a> more</div>"
    shells = [
        f"<h2>T</h2><script>pako('{packed('<p>wrong</p>')}')</script><script id='decompress-script'>var base64 = \"{packed('<p>One &amp; two</p>' + ads + '<p>three</p><script>x</script>')}\"</script>",
        f"<script id='decompress-script' data-base64='{packed('a<br/><br>&nbsp;<br><br>b')}'></script><div id='chapter-reading-content'>no</div>",
        f"<script>var other = 1</script><script>pako.inflate('{packed('line one' + chr(10) + ' '.join(map(str, range(200))))}')</script>",
        "<h1 id='chapter-heading'>H</h1><script id='decompress-script'>base64='!!'</script><div id='chapter-reading-content'><p>kept</p><script>no</script><p>too</p></div>",
        "<p>nothing</p>", None]
    got = extract.reader_content(pages(spark, *shells), rules.READER_CONTENT).orderBy("page_id").collect()
    assert [(r["title"], r["source"], r["text"]) for r in got] == [
        ("T", "payload", "One & two\nthree"), (None, "payload", "a\nb"), (None, "payload", "line one\n" + " ".join(map(str, range(200)))), ("H", "container", "kept\ntoo"), (None, None, None), (None, None, None)]
    assert got[0]["content"] == "<p>One &amp; two</p><p>three</p>" and got[1]["content"] == "<p>a</p><p>b</p>" and got[3]["content"] == "<p>kept</p><p>too</p>"


def test_rounds_follow_the_longest_chain_or_cycle(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(chains, "checkpointed", lambda df: cuts.append(1) or chains_checkpointed(df))
    rows = [(n * 4 + k, f"u{n}-{k}", f"u{n}-{(k + 1) % 4}") for n in range(500) for k in range(4)]
    got = chains.ranked_pages(spark.createDataFrame(rows, "page_id bigint, url string, next_url string"))
    assert {(r["page_id"], r["listing"], r["place"], r["cyclic"]) for r in got.collect()} == {(n * 4 + k, f"u{n}-0", k, True) for n in range(500) for k in range(4)}
    assert len(cuts) <= 10


def test_ranked_pages_against_walks(spark):
    """Random links: chains of any length, cycles, self links, shared next pages, repeated urls, pages never landed."""
    import random
    dice = random.Random(6)
    rows = [(i, f"u{i}", dice.choice([None, f"u{dice.randrange(70)}", f"u{i + 1}", f"u{i + 1}"])) for i in range(60)]
    rows += [(100 + i, f"v{i}", f"v{i + 1}") for i in range(40)] + [(200 + i, f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(300, "self", "self"), (301, "u3", "u9"), (None, "x", None)]
    known = {}
    for i, url, following in sorted((r for r in rows if r[0] is not None)):
        known.setdefault(url, (i, following))
    leader = {}
    for url, (i, following) in sorted(known.items(), key=lambda kv: kv[1][0]):
        if following in known:
            leader.setdefault(following, url)
    want = {}
    for url, (i, following) in known.items():
        walk, at = [url], url
        while at in leader and leader[at] not in walk:
            at = leader[at]
            walk.append(at)
        if leader.get(at) in walk:  # a cycle: its smallest page is first
            cycle = walk[walk.index(leader[at]):]
            head = min(cycle, key=lambda u: known[u][0])
            at, steps = url, 0
            while at != head:
                at, steps = leader[at], steps + 1
            want[i] = (head, steps, True)
        else:
            want[i] = (at, len(walk) - 1, False)
    got = chains.ranked_pages(spark.createDataFrame(rows, "page_id bigint, url string, next_url string"))
    assert {r["page_id"]: (r["listing"], r["place"], r["cyclic"]) for r in got.collect()} == want


def test_next_urls(spark):
    link = "<div class='p'><a href=''>no</a><a class='n' href='/l?page=3'>next</a></div>"
    rows = [(0, "https://h/l", "", "?page={n}", None), (1, "https://h/l?page=2", "", "?page={n}", None), (2, "https://h/l?s=1", "", "?page={n}", None), (3, "https://h/l/", "", "page/{n}", None),
            (4, "https://h/l/page/9/", "", "page/{n}/", None), (5, "https://h/l", link, None, ".p a[href]"), (6, "https://h/l", "<p>none</p>", "", ".p a"), (7, "https://h/l", link, None, None), (8, "https://h/l", link, "fixed", ".p a")]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, next_pattern string, next_selector string")
    assert {r["page_id"]: r["next_url"] for r in chains.next_urls(frame).collect()} == {
        0: "https://h/l?page=2", 1: "https://h/l?page=3", 2: "https://h/l?s=1&page=2", 3: "https://h/l/page/2", 4: "https://h/l/page/10/", 5: "https://h/l?page=3", 6: None, 7: None, 8: None}


def test_profile_content(spark):
    rows = [(1, "<div class='a'>one<p>two</p></div><div class='a'>no</div>", ".a"), (2, "<p>x</p>", ".a"), (3, "<p>x</p>", None), (4, None, "p"), (5, "<main><script>s</script> <b>y</b>&amp;z</main>", "main")]
    got = extract.profile_content(spark.createDataFrame(rows, "page_id int, html string, content_selector string")).orderBy("page_id").collect()
    assert [(r["text"], r["content"]) for r in got] == [("one\ntwo", "<p>one</p><p>two</p>"), (None, None), (None, None), (None, None), ("y\n&z", "<p>y</p><p>&amp;z</p>")]
