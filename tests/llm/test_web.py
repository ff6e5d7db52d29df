"""HTML extraction, URL rules, archives."""

import os
import re
import time
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import html, urls, warc
from rasterweave.llm.common import scratch


@pytest.fixture(scope="module")
def model():
    return html.default_model()


def test_leaf_blocks():
    page = "<body><p>One &amp; <b>t</b>wo\n  three<p>four<br>five<!-- no --><script>var t='</p>'</script><ul><li><a href=/>x</a><li>y</ul>caf&eacute; &#233;</body>"
    got = html.blocks_of(page)
    assert [b[0] for b in got] == ["One & two three", "four", "five", "x", "y", "café é"]
    assert [b[2] for b in got] == [0, 0, 0, 1, 0, 0]
    assert got[3][1] == ["<body>", "<ul>", "<li>"]
    for odd in (None, "", "<", "<p", "</p></div>", "<script>never closed", "<!-- open", "plain"):
        assert [b[0] for b in html.blocks_of(odd)] == (["plain"] if odd == "plain" else ["<"] if odd == "<" else [])


def test_hidden_elements_without_end_tags():
    article = "<article><p>One two.</p><p>Three.</p></article>"
    for before in ("<datalist><option value=a>A<option value=b>B</datalist>", "<div><button>Go</div>", "<button>Go", "<object data=x>", "<p><object data=x>no", "<select><option>a<option>b", "<canvas>", "<svg><path d=x>", "<noscript>", "<template>", "<div><option>a<optgroup><option>b</div>", "<button>Go<button>On</button>"):
        assert [b[0] for b in html.blocks_of(before + article)] == ["One two.", "Three."], before
    assert [b[0] for b in html.blocks_of("Some <button>Go" + article)] == ["Some", "One two.", "Three."]
    assert html.blocks_of("<button>Go" + article) == html.blocks_of(article)
    # closed ones are left out whole and do not end a block
    closed = "<p>a <button><div>Go</div> <a href=/>x</a></button>b <select><option>c<option>d</select>e <object><p>f<object>g</object></object>h<svg><title>i</title><g><path/></g></svg></p><div>j<noscript><p>k</noscript></div>"
    assert [(b[0], b[1], b[2]) for b in html.blocks_of(closed)] == [("a b e h", ["<p>"], 0), ("j", ["<div>"], 0)]
    assert [b[0] for b in html.blocks_of("x <button>y " * 20_000 + "</button>z")] == [" ".join(["x"] + ["z"])]


def test_broken_tags():
    for page, want in {
        '<p class="x>Second para <a href="y">link</a> more': ["Second para link more"],
        "<p class='x>Lost? no": ["Lost? no"],
        '<script src="a.js" />var leak=1;</script>ok': ["ok"],
        '<svg><script/><title>t</title></svg>ok': ["ok"],
        '<p data-x="1>2"class=y>t': ["t"],
        '<p title="a > b" id=it\'s>x</p>y': ["x", "y"],
        "a < b and <3<p>c": ["a < b and <3", "c"],
        "x<title>never closed <p>y": ["x", "y"],
        "x<!-->y<!--->z<!-- no -->1<?php no ?>2</ >3": ["xyz123"],
        "x<div": ["x"],
        "<SCRIPT>if (a</b) '</scriptx>'</Script  >z": ["z"],
    }.items():
        assert [b[0] for b in html.blocks_of(page)] == want, page
    got = html.blocks_of("<a href=/><div>inside</div></a><div>out</div><p><a>x</p><p>y</p>")
    assert [b[2] for b in got] == [6, 0, 1, 0]


@pytest.mark.parametrize("unit", ['<a b="c" ', "<div>", "<div>x", '<p class="x>y ', "<button>y ", "<a b='", "</x>", "<title>", "<option>a</svg>", "<b title=a'b>", "<!-- ", "<", "<svg>", "<li>a<ul>", "<textarea>x"])
def test_time_is_linear_in_the_page(unit):
    took = []
    for n in (250_000, 1_000_000):
        page, began = unit * (n // len(unit)), time.process_time()
        html.blocks_of(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5, took


def test_query_equals_the_articles_of_the_known_layout(spark, sf_dir):
    """The pages' main text is their one article: brute force cuts it out by its tags."""
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        bare = re.sub(r"</?(?:p|br|h1|ul|li|div)[^>]*>", " ", inside[1]) if inside else ""
        want[r.page_id] = " ".join(unescape(re.sub(r"<[^>]*>", "", bare)).split())
    got = html.op5_html_extraction(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_layouts_that_training_left_out():
    """Blocks of a layout that no training page had."""
    for out in html.LAYOUTS:
        model = html.BlockModel.fit(pages=350, layouts=tuple(k for k in html.LAYOUTS if k != out))
        hit = said = real = 0
        for page, marks in html.training_pages(80, 77, (out,)):
            blocks = html.blocks_of(page)
            labels = html.crf.viterbi(model.scores(blocks), model.transitions)
            hit, said, real = hit + int((labels & np.array(marks)).sum()), said + int(labels.sum()), real + sum(marks)
        # text outside of all elements is unlike anything in the other layouts
        assert 2 * hit / (said + real) > (0.7 if out == "bare" else 0.9), out


PAGES = {
    "<html><body><h1>Big title</h1><p>One two three four.</p><p>Second one, here.</p><p>Last of it all.</p></body></html>": "Big title One two three four. Second one, here. Last of it all.",
    "<html><body><h1>T</h1>" + "".join(f"<p>Paragraph {i} has some words.</p>" for i in range(5)) + "</body></html>": "T " + " ".join(f"Paragraph {i} has some words." for i in range(5)),
    "Just plain text": "Just plain text",
    "Some longer text, with a stop.<br>And a second line of it.": "Some longer text, with a stop. And a second line of it.",
    """<html><body class="single"><div id="page"><header id="masthead"><p>My site</p><nav class="main-navigation"><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav></header>
    <main id="primary"><article class="hentry post"><header class="entry-header"><h1>Rivers of the north</h1></header><div class="entry-content"><p>The first paragraph, about rivers.</p><p>The second one goes on.</p></div>
    <footer class="entry-footer">Tagged rivers</footer></article><div id="comments"><h2>2 thoughts</h2><ol><li><p>Nice post.</p></li><li><p>I agree.</p></li></ol></div></main>
    <aside id="secondary"><h3>Recent</h3><ul><li><a href=/>x</a></li></ul></aside><footer id="colophon">Powered by x</footer></div></body></html>""": "Rivers of the north The first paragraph, about rivers. The second one goes on.",
    "<body><div id=wrapper><nav><ul><li><a href=/>a</a><li><a href=/>b</a></ul></nav><section><h1>Title</h1><p>Some words here, ok.</p><p>Others there.</p></section><footer>&copy; us</footer></div></body>": "Title Some words here, ok. Others there.",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_of_other_shapes(model, page):
    assert model.main_text(page) == PAGES[page]


def test_training_labels_match_blocks_and_model_finds_main_text(model):
    right = total = 0
    for page, marks in html.training_pages(120, 99):
        blocks = html.blocks_of(page)
        assert len(blocks) == len(marks)
        want = " ".join(b[0] for b, k in zip(blocks, marks) if k)
        right += model.main_text(page) == want
        total += 1
    assert right / total > 0.9


def test_article_without_its_surroundings(model):
    page = """<html><body><div class='cookie-notice'>We use cookies &amp; more.</div><header><a href=/>Site</a></header><nav><ul><li><a href=#>Home</a></ul></nav>
    <div id="main"><h1>Big &eacute;vent</h1><p>One   two\n three <b>bo</b>ld.<p>Second para with, commas.<aside><p>Related: foo</p></aside><p>Third one here.</p>
    <div class='ad'>Buy now</div><p>Fourth.</p><div id='comments'><h3>2 comments</h3><div class='comment'>I disagree with this.</div></div></div>
    <form><label>Name</label><input></form><footer>&copy; 2020</footer>"""
    assert model.main_text(page) == "Big évent One two three bold. Second para with, commas. Third one here. Fourth."


def test_extract_edge_cases(spark, model):
    long = "<article>" + "<p>word and more words here.</p>" * 20_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<nav><a href=/>x</a></nav>"), (4, "<article><p>Fine words, here.</p></article>"), (4, "<article><p>Fine words, here.</p></article>"), (5, long), (None, "<article><p>No id at all.</p></article>")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1)), model=model)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert len(got) == 7 and out.columns == ["page_id", "html", "text", "n_chars"]
    by = {i: (t, n) for i, t, n in got}
    assert by[1] == by[2] == by[3] == ("", 0) and by[4] == ("Fine words, here.", 17) and by[None][0] == "No id at all."
    assert by[5][0] == " ".join(["word and more words here."] * 20_000)
    assert html.extract(out.select("page_id", "html").where("false"), model=model).count() == 0


RULES = urls.DEFAULT_RULES
URLS = [
    ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://EXAMPLE.org/en/123?x#y", "example.org", "/en/123", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/es/", "x.com", "/es/", None, "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.org", "a.org", "", None, "allow"), ("http://a.org?q=/es/", "a.org", "", None, "allow"), ("no scheme/es/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://y://z.com/de/", "y:", "//z.com/de/", None, "allow"), ("http://ÀB.COM/de/", "Àb.com", "/de/", "com/de/", "block"), ("http:///de/", "", "/de/", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, rule string")
    rows = urls.filter_urls(pages, urls.rule_table(spark)).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in rows] == URLS + URLS[:2]
    none = urls.filter_urls(pages, urls.rule_table(spark).where("false"), default="block").collect()
    assert {r.verdict for r in none} == {"block"} and {r.rule for r in none} == {None}
    assert urls.filter_urls(pages.where("false"), urls.rule_table(spark)).count() == 0


def test_url_prefix_collisions_are_confirmed(spark):
    """With one hex digit as prefix nearly all rules collide; digests decide."""
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    rows = urls.filter_urls(pages, urls.rule_table(spark), prefix_hex=1).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [u[3:] for u in URLS]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a.b/c d", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\nx"), ("dns:a.b", "1.2.3.4", "2001", "text/dns", b""), ("http://e/", "-", "x", "image/gif", bytes(range(256)))]
    data = warc.build_arc(records, version)
    got = list(warc.parse_arc(data))
    assert [r[:5] for r in got] == [("http://a.b/c%20d", *records[0][1:])] + records[1:] and not any(r.truncated for r in got)
    assert list(warc.parse_arc(data[:-9]))[-1].truncated
    assert list(warc.parse_arc(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_arc(data.replace(b"dns:a.b 1.2.3.4", b"dns:a.b")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 1 2 3 4\n"))


def test_dates_and_identifiers():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.iso_date("2001") == "2001-01-01T00:00:00Z" and warc.iso_date("-") == "1970-01-01T00:00:00Z"
    assert warc.record_id("a", 1) == warc.record_id("a", 1) != warc.record_id("a", 2)


def test_conversion_writes_revisits(spark):
    long, short = "x" * 1500, "y" * 10
    rows = [(1, "http://a/", long), (5, "http://b/", long), (3, "http://c/", long), (2, None, short), (4, "http://d/", short), (6, "http://e/", None), (7, "http://e/", ""), (None, "http://f/", long), (8, "http://g/", "é" * 70_000), (9, "http://h/", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    folder = scratch(spark, "test-warc")
    warc.convert(warc.arcs_of_pages(pages, arc_bytes=2000), folder, file_bytes=2000)
    got = {r.page_id: r for r in warc.read_warcs(spark, folder).collect()}
    assert len(got) == len(rows)
    of = {r.record_id: i for i, r in got.items()}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {1, 3, None, 8}
    assert [of[got[i].refers_to_id] for i in (1, 3, None, 8)] == [5, 5, 5, 9]
    assert got[1].payload_bytes == 1500 and got[1].payload_digest == got[5].payload_digest and got[6].payload_bytes == 0 and got[8].payload_bytes == 140_000


def test_repeated_pages_have_one_response_and_their_own_ids(spark, tmp_path):
    long = "x" * 1500
    rows = [(5, "http://a/", long), (5, "http://a/", long), (3, "http://a/", long), (3, "http://a/", long), (7, "http://b/", "short"), (7, "http://b/", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1)).withColumn("path", F.lit("x")).repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = warc.op7_warc_conversion(spark, f"file://{tmp_path}").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(3, "revisit", 5), (3, "revisit", 5), (5, "response", 0), (5, "revisit", 5), (7, "response", 0), (7, "response", 0)]
    folder = scratch(spark, "test-warc")
    warc.convert(warc.arcs_of_pages(spark.read.parquet(f"file://{tmp_path}/pages.parquet")), folder)
    assert warc.read_warcs(spark, folder).select("record_id").distinct().count() == 6


def test_archives_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert warc.op7_warc_conversion(spark, f"file://{tmp_path}").count() == 0


def test_resource_records_and_empty_archives(spark):
    data = warc.build_arc([("dns:a", "1.1.1.1", "2001", "text/dns", b"a. 1 IN A 1.1.1.1")], 2)
    folder = scratch(spark, "test-warc")
    warc.convert(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b""))], "path string, content binary"), folder)
    assert [(r.record_type, r.payload_bytes) for r in warc.read_warcs(spark, folder).collect()] == [("resource", 17)]


@pytest.mark.parametrize("name", ["op6_url_filters", "op7_warc_conversion"])
def test_queries_equal_sql(spark, sf_dir, name):
    from rasterweave.llm import queries

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{os.path.join(sf_dir, 'pages')}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)
