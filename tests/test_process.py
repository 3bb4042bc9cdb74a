"""Hand-written fixtures for the extraction and processing quirks."""
from pyspark.sql import functions as F

from webloom.operators.extract import extract_raw
from webloom.operators.process import process, process_records

BASE = "https://www.h.example/dir/page.html"


def run(spark, html, url=BASE, mode="static"):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return process(extract_raw(pages, mode), "2026-01-01 00:00:00")


def body(inner):
    long_text = "word " * 60
    return f"<html lang='en'><head><title> T </title></head><body><article><h1>H</h1><p>{long_text}</p>{inner}</article></body></html>"


def test_missing_url_is_error(spark):
    p = run(spark, body(""), url="")
    errs = p.errors.collect()
    assert len(errs) == 1 and errs[0].error == "Missing URL" and errs[0].links_found == 0
    assert p.pages.count() == 0


def test_no_title_no_content_warnings(spark):
    p = run(spark, "<html><body></body></html>")
    rec = p.records.select("validation").first().validation
    assert rec.valid and rec.warnings == ["No content extracted", "No title found"]


def test_duplicate_links_first_wins(spark):
    # extraction resolves ' /c' and '/c' to the same absolute URL, so they
    # de-duplicate; raw records keep both (covered by the normalize_links query)
    links = '<a href="/a">1</a><a href="/b">2</a><a href="/a">3</a><a href=" /c">4</a><a href="/c">5</a>'
    rows = run(spark, body(links)).links.orderBy("link_number").collect()
    assert [(r.link_number, r.link_url.rsplit("/", 1)[1], r.link_text) for r in rows] == \
        [(1, "a", "1"), (2, "b", "2"), (3, "c", "4")]


def test_pseudo_links_dropped_and_external(spark):
    links = ('<a href="javascript:x()">j</a><a href="MAILTO:a@b">m</a><a href="tel:1">t</a><a href="data:x">d</a>'
             '<a href="ftp://f/x">f</a><a href="file:///x">F</a><a href="#t">hash</a>'
             '<a href="https://h.example/">bare</a><a href="https://www.h.example:443/">port</a>'
             '<a href="https://h.example/a b">space</a>')
    rows = run(spark, body(links)).links.orderBy("link_number").collect()
    got = [(r.link_text, r.is_external) for r in rows]
    # '#t' was resolved to base#t during extraction, so it survives (quirk Q3)
    assert got == [("hash", False), ("bare", True), ("port", True)]


def test_image_with_space_counted_not_listed(spark):
    imgs = '<img src="/i.png" alt="A"><img src="a b.png"><img src="/i.png"><img src="data:x">'
    p = run(spark, body(imgs))
    assert p.pages.first().image_count == 2
    rows = p.images.collect()
    assert [(r.image_id, r.image_alt) for r in rows] == [("1_img_1", "A")]


def test_text_cleaning_and_double_unescape(spark):
    html = body("<p>tab\there\xa0nbsp \x07 bell &amp;lt;x&amp;gt;</p>")
    rec = process_records(extract_raw(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")), "2026-01-01 00:00:00")
    paras = rec.first().content.paragraphs
    assert paras[-1] == "tab here nbsp  bell &lt;x&gt;"
    # the text is cleaned twice (scraper, then processor): the double space collapses
    assert rec.first().content.text.endswith("tab here nbsp bell <x>")


def test_main_content_priority(spark):
    html = "<body><main>" + "m" * 200 + "</main><article>" + "a" * 201 + "</article></body>"
    raw = extract_raw(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string"))
    assert raw.first().main_selector == "article"


def test_nested_lists_and_form(spark):
    html = body('<ul><li>x<ul><li>y</li></ul></li></ul>'
                '<form METHOD="POST"><input name="q" required><select name="s"><option value="a" selected> A </option>'
                '<option>B</option></select><textarea></textarea></form>')
    raw = extract_raw(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")).first()
    assert [(l.type, l.items) for l in raw.content.lists] == [("ul", ["xy", "y"]), ("ul", ["y"])]
    f = raw.forms[0]
    assert f.action == BASE and f.method == "post"
    assert [(x.name, x.type, x.required) for x in f.fields] == [("q", "input", True), ("s", "select", False),
                                                                 ("", "textarea", False)]
    assert [(o.value, o.text, o.selected) for o in f.fields[1].options] == [("a", "A", True), ("", "B", False)]


def test_meta_og_and_dynamic_frameworks(spark):
    html = ('<html><head><meta name="description" content=" d1 "><meta name="description" content="d2">'
            '<meta property="og:title" content="A"><meta property="og:title" content="B"></head>'
            '<body data-reactroot><article>' + "x " * 150 + '</article></body></html>')
    df = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    s = extract_raw(df, "static").first()
    assert s.metadata.description == "d1" and s.metadata.open_graph == {"og:title": "B"} and s.metadata.author is None
    d = extract_raw(df, "dynamic").first()
    assert d.metadata.description == "d2" and d.frameworks == {"react": True} and d.metadata.domain == "www.h.example"
