"""H0 at size: text access linear in the page, tasks of equal bytes, and the
counts that are made without the records."""
import time

from pyspark.sql import functions as F

from webloom.operators.dom import parse_dom
from webloom.operators.extract import dom_to_facts, extract_raw
from webloom.operators.process import links_table, page_facts, page_statistics, pages_table, process_records
from webloom.plans.rich import rich_pages
from webloom.sources.pages import scan_pages, spread_by_bytes

SF = "/root/testdata/sf0.001"
TS = "2026-01-01 00:00:00"


def page(size):
    block = '<h2>Ünder a title</h2><p>A paragraph of some words, é and more.</p><ul><li>one</li></ul><a href="/x{}">a link</a>'
    return "<html><body><main>" + "".join(block.format(i) for i in range(size // len(block))) + "</main></body></html>"


def test_text_access_is_linear_in_the_page(spark):
    def seconds(size):
        df = spark.createDataFrame([(1, "https://h/", page(size))], "page_id long, url string, html string")
        raw = extract_raw(df, fields=("content", "links"))
        t = time.time()
        out = raw.select(F.size("content.paragraphs"), F.size("content.lists"),
                         F.expr("aggregate(links, 0, (a, l) -> a + length(l.text))"), "text_strip_length").first()
        return time.time() - t, out[0]
    seconds(100_000)
    half, n = seconds(500_000)
    whole, twice = seconds(1_000_000)
    assert abs(twice - 2 * n) <= 2 and whole < 2.5 * max(half, 1.0)


def test_tasks_of_equal_bytes(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * 2_000) for i in range(400)] + [(7, "hot", "y" * 2_000)] * 300 + [(9999, "large", "z" * 3_000_000), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for pages in (spread_by_bytes(df, 200_000), None):
        if pages is None:
            df.write.parquet(f"{tmp_path}/pages.parquet")
            pages = scan_pages(spark, f"{tmp_path}/pages.parquet", task_bytes=200_000)
        assert pages.columns == ["page_id", "url", "html"]
        assert sorted(map(tuple, pages.collect()), key=str) == sorted(rows, key=str)
        tasks = {r[0]: r for r in pages.groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.length("html")), F.lit(0)), F.max(F.length("html"))).collect()}
        large = [r for r in tasks.values() if r[3] == 3_000_000]
        assert len(large) == 1 and large[0][1] == 1                       # alone
        assert len(tasks) >= 8 and all(r[2] <= 250_000 for r in tasks.values() if r not in large)
    assert spread_by_bytes(df.limit(0)).collect() == []


def test_facts_are_those_of_the_records(spark):
    pages = rich_pages(spark, SF).unionByName(spark.createDataFrame([
        (900, "https://h/d/", '<body><a href="x y">1</a><a href="HTTP://U.example/a">2</a><a href="http://[bad/">3</a><a href=" /p ">4</a>'
         '<a href="/p">5</a><img src=" /i "><img src="ftp://x/i"><form></form><main>' + "w &amp;amp; \x07 " * 60 + "</main></body>"),
        (901, None, "<a href='/x'>a</a>"), (902, "https://h/", None), (903, "", ""), (904, "nohost", "<a href='z'>a</a><img src='q'>")],
        "page_id long, url string, html string"))
    for mode in ("static", "dynamic"):
        rec = process_records(extract_raw(pages, mode), TS, mode)
        facts = page_facts(dom_to_facts(parse_dom(pages), mode), TS, mode)
        for make in (pages_table, page_statistics):
            assert sorted(map(str, make(facts).collect())) == sorted(map(str, make(rec).collect()))
    some = process_records(extract_raw(pages, fields=("links",)), TS)
    full = process_records(extract_raw(pages), TS)
    assert sorted(map(str, links_table(some).collect())) == sorted(map(str, links_table(full).collect()))


def test_a_parse_decodes_a_megabyte_at_a_time():
    import pyarrow as pa
    from webloom.operators import dom
    from webloom.sources import pages

    docs = pa.array(["x" * 3000, None, "é" * 400_000, "y" * 700_000, ""] + ["z" * 10_000] * 500)
    cuts = list(dom._slices(docs))
    assert [at for at, _ in cuts] == [0] + [sum(n for _, n in cuts[:i]) for i in range(1, len(cuts))] and sum(n for _, n in cuts) == len(docs)
    assert all(n == 1 or sum(len((d or "").encode()) for d in docs.slice(at, n).to_pylist()) <= 1 << 20 for at, n in cuts)
    assert list(dom._slices(pa.array([], pa.string()))) == [(0, 0)]
    assert pages.TASK_BYTES <= 8 << 20                              # before 32 MB: four times the Python of a large input
