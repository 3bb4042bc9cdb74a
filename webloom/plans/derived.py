"""Stand-in inputs built from the driver tables.

The driver's ``pages`` have only root-relative links and no images, forms,
captchas, fetch metadata or robots files.  These builders only produce rows
in the schema each job expects; the jobs themselves run unchanged on them.
Each builder has an SQL twin in ``oracle.py`` so the oracle sees the same
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import expr
from ..functions.urls import url_split_sql
from ..sources.pages import TASK_BYTES, scan_pages


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _part_page(spark: SparkSession, sf: str):
    """The page of a part: its key modulo the number of pages, whose ids run
    from 0, so that every part has a page."""
    n = _t(spark, sf, "pages").agg(F.max("page_id")).first()[0] + 1
    return F.pmod(F.col("p_partkey"), F.lit(n)).alias("page_id")


def part_images(spark: SparkSession, sf: str) -> DataFrame:
    """Image rows: every part becomes an image of a page, with four kinds of src: root-relative, absolute on
    another host, a data: URI and a relative path containing spaces."""
    part = _t(spark, sf, "part")
    pages = _t(spark, sf, "pages").select("page_id", F.col("url").alias("base_url"))
    src = expr("CASE p_partkey % 4 WHEN 0 THEN concat('/img/', p_partkey % 7, '.png') "
               "WHEN 1 THEN concat('https://cdn.example.com/', p_partkey % 5) "
               "WHEN 2 THEN 'data:x' ELSE ' a b.png' END")
    rows = part.select(_part_page(spark, sf), F.col("p_partkey").alias("pos"),
                       src.alias("src"), F.col("p_name").alias("alt"))
    return rows.join(pages, "page_id")


def part_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link rows: every part becomes a link of a page, with six kinds of href: root-relative, mailto:, fragment, absolute
    external (with a fragment), space-padded root-relative and an
    upper-case scheme."""
    part = _t(spark, sf, "part")
    pages = _t(spark, sf, "pages").select("page_id", F.col("url").alias("base_url"))
    href = expr("CASE p_partkey % 6 WHEN 0 THEN concat('/p/', p_size) "
                "WHEN 1 THEN concat('mailto:x', p_partkey, '@example.com') WHEN 2 THEN '#frag' "
                "WHEN 3 THEN concat('https://other.example/', p_brand) "
                "WHEN 4 THEN concat('  /p/', p_size) ELSE concat('HTTP://UPPER.example/x', p_size) END")
    rows = part.select(_part_page(spark, sf), F.col("p_partkey").alias("pos"),
                       href.alias("url"), F.col("p_name").alias("text"))
    return rows.join(pages, "page_id")


# Request URLs that exercise the request checks.
EXTRA_REQUEST_URLS = [
    "http://localhost/x", "http://10.1.2.3/a", "https://h.example.com/v10.2", "https://h.example.com:80/p",
    "ftp://h.example/f", "http://user:pw@h.example.com/", "http://192.168.0.1/", "javascript:alert(1)", "",
    "   https://ok.example/  ", "https://[::1]/", "http://172.20.1.1/", "http://169.254.0.1/",
]


def request_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Requests: every page URL plus the fixed probe URLs, with a request
    type taken from the URL's language segment."""
    pages = _t(spark, sf, "pages").select("url")
    extra = spark.createDataFrame([(u,) for u in EXTRA_REQUEST_URLS], "url string")
    urls = pages.unionByName(extra)
    rtype = expr("CASE WHEN url LIKE '%/en/%' THEN 'static' WHEN url LIKE '%/fr/%' THEN 'dynamic' "
                 "WHEN url LIKE '%/de/%' THEN 'bogus' ELSE 'auto' END")
    return urls.select("url", rtype.alias("scraping_type"))


def fetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with fetch metadata: status and ``server`` header from the URL."""
    pages = scan_pages(spark, f"{sf}/pages.parquet", task_bytes=TASK_BYTES)
    status = expr("CASE WHEN url LIKE '%spam%' THEN 403 WHEN url LIKE '%?page=2%' THEN 429 "
                  "WHEN url LIKE '%.html' THEN 503 WHEN url LIKE '%#top' THEN 404 ELSE 200 END")
    server = expr("map('server', CASE WHEN url LIKE 'https://m.%' THEN 'cloudflare' ELSE 'nginx' END)")
    return pages.select("page_id", "url", "html", status.alias("http_status_code"), server.alias("headers"))


ROBOTS_WWW = "User-agent: EthicalWebScraper\nDisallow: /en/\nAllow: /\n"
ROBOTS_DEFAULT = "# site rules\nUser-agent: *\nAllow: /fr/1\nDisallow: /fr/\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\n"


def robots_files(spark: SparkSession, sf: str) -> DataFrame:
    """One robots.txt per origin of the pages: a named group for our agent on
    www. hosts, a '*' group on the others, none on blog. hosts."""
    pages = _t(spark, sf, "pages")
    origins = pages.select(expr(f"{url_split_sql('url')}").alias("p")) \
        .select(F.concat("p.scheme", F.lit("://"), "p.netloc").alias("origin"), F.col("p.netloc").alias("netloc")) \
        .distinct()
    body = F.when(F.col("netloc").startswith("www."), F.lit(ROBOTS_WWW)).otherwise(F.lit(ROBOTS_DEFAULT))
    return origins.filter(~F.col("netloc").startswith("blog.")).select("origin", body.alias("body"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Progress events: session = user, step = event type, progress = value."""
    ev = _t(spark, sf, "events")
    status = expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END")
    return ev.select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"),
                     F.col("value").alias("progress"), F.col("event_type").alias("step"), status.alias("status"))


def run_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Run-log text lines: a start line per event and, unless the event is
    an error, a finish line ``value`` seconds later."""
    ev = _t(spark, sf, "events")
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example/"))
    start = ev.select((F.col("event_id") * 2).alias("line_no"), F.col("ts").cast("timestamp").alias("t"),
                      F.concat(F.lit("Starting scraping session "), F.col("event_id").cast("string"), F.lit(" for "), url).alias("msg"))
    finish = ev.filter("event_type != 'error'").select(
        (F.col("event_id") * 2 + 1).alias("line_no"),
        expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) + CAST(value * 1000000 AS BIGINT))").alias("t"),
        F.concat(F.lit("Successfully scraped "), url).alias("msg"))
    lines = start.unionByName(finish)
    return lines.select("line_no", F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss,SSS"),
                                            F.lit(" - scraping_manager - INFO - "), F.col("msg")).alias("value"))


def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the page tables: each page scraped at 2026-01-01 + page_id
    hours, so runs have distinct times."""
    pages = _t(spark, sf, "pages")
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html",
                        expr("timestamp_micros(unix_micros(TIMESTAMP'2026-01-01 00:00:00') + page_id * 3600000000)").alias("scraped_at"))


FORM_HTML = ('<form METHOD="POST" class="f"><input name="q" required placeholder="search">'
             '<select name="s"><option value="a" selected> A </option><option>B</option></select>'
             '<textarea name="t"></textarea></form>')


def enriched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with meta description, two og:title tags, a form and a React
    root marker added (the driver pages have none of these)."""
    pages = scan_pages(spark, f"{sf}/pages.parquet", task_bytes=TASK_BYTES)
    lang = "regexp_extract(html, 'lang=\"([^\"]*)\"', 1)"
    head = (f"concat('<head><meta name=\"description\" content=\" d-', {lang}, ' \">"
            f"<meta property=\"og:title\" content=\"x1\"><meta property=\"og:title\" content=\"', {lang}, '\">')")
    html = (f"replace(replace(replace(html, '<head>', {head}), '</article>', '{FORM_HTML}</article>'), "
            f"'<body>', '<body><div data-reactroot></div>')")
    return pages.select("page_id", "url", expr(html).alias("html"))
