import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from serialake import fixed
from serialake.functions import lines, markup, payload, text, urls


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_slug(spark):
    assert values(spark, ["Chương 1: Bắt đầu!", "Hello world!? 123", None], text.slug("v")) == ["chuong-1-bat-dau", "hello-world-123", ""]


def test_part_number(spark):
    titles = ["Chương 12", "Chapter 5", "001. Title", "March 5", "Title", None, "12"]
    assert values(spark, titles, text.part_number("v")) == [12, 5, 1, 5, None, None, None]


def test_prefix_removal_cuts_original_characters(spark):
    titles = ["Chương 10: ABC", "Chapter 9 - XYZ", "7. Đường", "Tiêu đề", None]
    assert values(spark, titles, text.strip_part_number("v")) == ["ABC", "XYZ", "Đường", "Tiêu đề", ""]


def test_file_name(spark):
    assert values(spark, ["Tiêu đề", "!!"], text.part_file_name("v", F.lit(3))) == ["0003_tieu-de.txt", "0003_untitled.txt"]


def test_transliteration(spark):
    assert values(spark, ["Straße Œuvre “Đá” – é…", "plain"], text.to_ascii("v")) == ['Strasse OEuvre "Da" - e...', "plain"]


def test_genre_name(spark):
    assert values(spark, [" Tiên Hiệp 2115", "Kiếm [ 12 ] (3)", None], text.genre_name("v")) == ["Tiên Hiệp", "Kiếm", ""]


def test_digits_and_label(spark):
    assert values(spark, ["1.234", "3 of 10", "x", None], text.digits_as_int("v")) == [1234, 310, None, None]
    assert values(spark, ["chapter-7-of-9", "vol 3 part", "none"], text.label_number("v")) == [7, 3, None]


def test_white_space_is_unicode(spark):
    assert values(spark, [" a  b\n", None], text.collapse_space("v")) == ["a b", ""]
    assert values(spark, ["  a b　"], text.uni_trim("v")) == ["a b"]


def test_warning_line(spark):
    line = "12:00 [WARNING] Sau crawl bù, truyện 'Đại Đạo' vẫn thiếu chương: 10+2/30"
    got = values(spark, [line, "[INFO] ok"], text.parse_warning("v"))
    assert tuple(got[0]) == ("Đại Đạo", 10, 2, 30)
    assert tuple(got[1]) == (None, None, None, None)


def test_chunks(spark):
    body = "x" * 4000 + "y" * 4000 + "z"
    assert values(spark, [body, "", None], text.chunks("v")) == [["x" * 4000, "y" * 4000, "z"], [], []]


def test_backoff(spark):
    assert values(spark, [0, 1, 3, 4, 9], text.backoff_seconds("v"), "v int") == [5, 10, 40, 60, 60]


def test_category_name(spark):
    df = spark.sql("select array(named_struct('name', 'a', 'url', '/a')) c union all select array() union all select null")
    assert sorted(r[0] for r in df.select(text.category_name("c", F.lit("g"))).collect()) == ["a", "g", "g"]


@pytest.mark.parametrize("href,expected", [
    ("/a/b", "https://h.example/a/b"), ("c", "https://h.example/x/c"), ("../c?p=1", "https://h.example/c?p=1"), ("./d#e", "https://h.example/x/d#e"),
    ("?q=2", "https://h.example/x/y?q=2"), ("#f", "https://h.example/x/y?k=1#f"), ("//o.example/z", "https://o.example/z"),
    ("http://o.example/", "http://o.example/"), ("", "https://h.example/x/y?k=1#t"), ("/a/../../b/", "https://h.example/b/"),
])
def test_absolute_url(spark, href, expected):
    assert values(spark, [href], urls.absolute_url(F.lit("https://h.example/x/y?k=1#t"), F.col("v"))) == [expected]


def test_page_parameter(spark):
    given = ["https://h/a/page/2", "https://h/a-trang-3", "https://h/a?x=1&page=2#z", "https://h/a?x=1", "https://h/a"]
    assert values(spark, given, urls.with_page("v", F.lit(7))) == [
        "https://h/a/page/7", "https://h/a-trang-7", "https://h/a?x=1&page=7#z", "https://h/a?x=1&page=7", "https://h/a?page=7"]
    assert values(spark, given[:1], urls.with_page("v", F.lit(1))) == given[:1]


def test_base_and_work_urls(spark):
    assert values(spark, ["https://host/!", "host", " ", "'#"], urls.clean_base_url("v")) == ["https://host", "https://host", None, None]
    home = F.lit("https://h.example/")
    assert values(spark, ["/alias", "https://h.example/tong-hop/alias/", "/doc-truyen/a", ""], urls.work_url("v", home)) == [
        "https://h.example/doc-truyen/alias", "https://h.example/doc-truyen/alias", "https://h.example/doc-truyen/a", ""]
    assert values(spark, ["https://m.h.example:81/x", "https://mobile.h.example", "https://mm.example"], urls.desktop_url("v")) == [
        "https://h.example:81/x", "https://h.example", "https://mm.example"]


def test_site_needs_exact_host(spark):
    sites = spark.createDataFrame([("a", "https://A.example"), ("b", "http://b.example:8080/x")], "site_key string, base_url string")
    rows = spark.createDataFrame([("https://a.example/1",), ("https://u@a.example/1",), ("http://b.example:8080",), ("http://b.example",), (None,)], "url string")
    assert [r["site_key"] for r in urls.with_site_key(rows, sites, url="url").orderBy(F.col("url")).collect()] == [None, None, "b", "a", None]


def test_line_filter(spark):
    body = "Menu chính\n  Một dòng dài bình thường  \n\nab\nab.\n=====\nNguồn: x\nTHAM GIA FANPAGE nhé\n(Tấu chương xong)\nXin chào \"x\""
    assert values(spark, [body], lines.filter_lines("v")) == ["Một dòng dài bình thường\nab.\nXin chào \"x\""]


def test_line_filter_is_unicode_case_insensitive(spark):
    assert values(spark, ["QUẢNG CÁO hay\nkhông phải"], lines.filter_lines("v")) == ["không phải"]


def test_leading_headers(spark):
    body = "\nNguồn: a\n\nTRUYỆN: b\nNội dung\n\nChương: giữ lại\n"
    assert values(spark, [body, "Chương: 1\nThể loại: 2", "", None], lines.drop_leading_headers("v")) == ["Nội dung\nChương: giữ lại", "", "", ""]


def test_block_pages(spark):
    long_text = "word " * 60
    pages = [
        "Bạn đã bị chặn vì lý do", "<html><head><title>Just a moment...</title></head><body>" + long_text + "</body></html>",
        "Một đoạn văn bình thường", f"<html><head><title>Truyện</title></head><body><p>{long_text}</p></body></html>",
        "just a moment, says cloudflare", "<html><body><p>You must enable JavaScript to view this page properly, friend of ours here.</p><p>Thanks a lot!</p></body></html>",
        f"<html><body><p>enable javascript {long_text}</p></body></html>", None,
    ]
    assert values(spark, pages, lines.is_block_page("v")) == [True, True, False, False, True, True, False, False]


def test_fragment_to_text(spark):
    html = "<p>a&nbsp;</p><p> b</p>x<br>y<br/><br>z<div>\n\n</div>&lt;end&gt;"
    assert values(spark, [html, None], markup.fragment_to_text("v")) == ["a\nb\nx\n\ny\n\nz\n\n<end>", ""]


def test_noise_removal_handles_nesting(spark):
    html = '<div>a<div class="x ads-top"><div>no</div>no</div><!-- c --><script>1</script><p class="box-notice">no</p>b</div>'
    assert values(spark, [html], payload.remove_noise(F.col("v"))) == ["<div>ab</div>"]


def test_payload(spark):
    # Digests hardly compress, so the packed literal is long enough for the anonymous form.
    body = "".join(f"<p>Chương {hashlib.sha256(bytes([i])).hexdigest()}</p>" for i in range(8))
    packed = base64.b64encode(zlib.compress(body.encode())).decode()
    raw = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    deflated = base64.b64encode(raw.compress(body.encode()) + raw.flush()).decode()
    scripts = [f"var base64 = '{packed}';", f"<i data-base64=\"{packed[:20]}\n{packed[20:]}\">", f'x = "{"A" * 200}"; y = `{deflated}`', "nothing", None]
    assert values(spark, scripts, payload.embedded_payload(F.col("v"))) == [body, body, body, None, None]


def test_rating_and_identifiers(spark):
    html = ('<script type="application/ld+json">{"aggregateRating": {"ratingValue": "4.5", "reviewCount": 0, "ratingCount": 12}}</script>'
            '<body class="single postid-77 x"><script>{"security":"abc"}</script>')
    assert tuple(values(spark, [html], markup.rating(markup.json_ld("v")))[0]) == ("4.5", "12")
    assert values(spark, [html], markup.first_of("v", markup.NONCE_PATTERNS)) == ["abc"]
    assert values(spark, [html], markup.first_of("v", markup.WORK_ID_PATTERNS)) == ["77"]


def test_page_count(spark):
    html = '<a href="?page=3">x</a><select><option value="5">5</option></select><li data-page="4"></li><a> 6 </a><a href="/trang-7/">n</a>'
    assert values(spark, [html, "", None], markup.page_count("v")) == [7, 1, 1]


def test_page_count_ignores_numbers_elsewhere(spark):
    pages = ['<ul class="pagination"><li><a href="#">2</a></li><li><a href="#">3</a></li></ul><a href="/y">2024</a>',
             '<option value="9">9</option><select><option value="4 x">4</option><option data-value="8" value=\'2\'>2</option></select>',
             '<i data-page="12x"></i><i data-page=5></i><i x-data-page="7"></i>',
             '<ul class="my-pagination"><li><a>6</a></li></ul><UL CLASS="a pagination b"><li><a>2</a>']
    assert values(spark, pages, markup.page_count("v")) == [3, 2, 5, 2]


def test_trim_to_bytes(spark):
    html = "<html><body>" + "é" * 10 + "<svg>x</svg></body></html>"
    got = values(spark, [html], markup.trim_to_bytes("v", 11))
    assert got == ["<body>éé"]
    assert values(spark, [html], markup.trim_to_bytes("v", 1000)) == ["<body>" + "é" * 10 + "</body>"]


def test_rule_split():
    regexes, literals = lines.split_rules(["^a", "B c", "x.y"])
    assert (regexes, literals) == (["^a", "x.y"], ["b c"])
    assert len(fixed.JOB_REQUIRED_FIELDS) == 8


def test_titles_of_other_scripts_stay(spark):
    titles = ["Chapter 1: 第一章", "Глава Первая", "Élan ΩΜΕΓΑ 2!"]
    assert values(spark, titles, text.match_key("v")) == ["第一章", "глава первая", "elan ωμεγα 2"]
    assert values(spark, titles[1:], text.slug("v")) == ["глава-первая", "elan-ωμεγα-2"]
    assert values(spark, ["Chapter 123456: x", "Chapter 99999999999999999999"], text.part_number("v")) == [123456, None]
