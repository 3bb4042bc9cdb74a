"""Registered queries: one per operator of SURVEY §2, each with a DuckDB
oracle where SQL can express it.

Every query reads the driver tables (``pages``, ``events``, ``documents``,
``part``) — or inputs Spark derives from them — so its work grows with the
data.  Integer outputs are cast to BIGINT on both sides so the oracle
compare sees one type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions import urls as U
from ..operators.extract import RAW_FIELDS, dom_to_facts, extract_raw
from ..operators.dom import parse_dom
from ..operators.process import each, headings_table, links_table, page_facts, page_statistics, pages_table, process_records
from ..session import staged
from ..sources.pages import TASK_BYTES, scan_pages
from . import oracle as O

RUN_TS = "2026-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Cast every integral column to bigint (oracle compare sees one type)."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name)
                       if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name)
                       for f in df.schema.fields])


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table in tasks of equal bytes: its files have few row groups,
    and the parse is bound by CPU."""
    return scan_pages(spark, f"{sf_dir}/pages.parquet", task_bytes=TASK_BYTES)


def raw_pages(spark: SparkSession, sf_dir: str, mode: str = "static", tags: frozenset[str] | None = None,
              fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """H0 over the pages table (one parse per page)."""
    return extract_raw(pages_of(spark, sf_dir), mode, tags=tags, fields=fields)


def records(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """C1 records of the pages table."""
    return process_records(raw_pages(spark, sf_dir, fields=fields), RUN_TS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the pages table, for A1 to A3."""
    return page_facts(dom_to_facts(parse_dom(pages_of(spark, sf_dir))), RUN_TS)


def _pid(c="page_id") -> Column:
    return F.col(c).cast("string").alias("page_id")


# ==========================================================================
# Extraction (H*)

@query("links_table", f"""
WITH {O.ANCHORS},
dedup AS (SELECT *, row_number() OVER (PARTITION BY page_id, abs_url ORDER BY pos) AS rn FROM anc_rows)
SELECT CAST(page_id AS VARCHAR) AS page_id,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS link_number,
       abs_url AS link_url, {O.strip('atext')} AS link_text, '' AS link_title, false AS is_external
FROM dedup WHERE rn = 1
""")
def q_links_table(spark, sf):
    """W1 (+H10, D1, F6, P3, F5): the links table of every page."""
    return longs(links_table(records(spark, sf, ("links",))).drop("scraped_at"))


@query("extract_links", f"""
WITH {O.ANCHORS}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(pos AS BIGINT) AS pos, abs_url AS url,
       {O.strip('atext')} AS text, false AS is_external
FROM anc_rows
""")
def q_extract_links(spark, sf):
    """Every a[href] with absolute url and stripped text, before dedup."""
    raw = raw_pages(spark, sf, tags=frozenset(["a"]), fields=("links",))
    return longs(each(raw.withColumn("page_id", _pid()), "links", "page_id")
                 .select("page_id", (F.col("pos") + 1).alias("pos"), "x.url", "x.text", "x.is_external"))


@query("extract_title", f"WITH {O.PAGES_MAIN} SELECT CAST(page_id AS VARCHAR) AS page_id, title_raw AS title FROM pm")
def q_extract_title(spark, sf):
    """H1: title of every page."""
    raw = raw_pages(spark, sf, tags=frozenset(["title"]), fields=("metadata",))
    return raw.select(_pid(), F.col("metadata.title").alias("title"))


@query("extract_language", f"WITH {O.PAGES_MAIN} SELECT CAST(page_id AS VARCHAR) AS page_id, lang AS language FROM pm")
def q_extract_language(spark, sf):
    """H4: <html lang>."""
    raw = raw_pages(spark, sf, tags=frozenset(["html"]), fields=("metadata",))
    return raw.select(_pid(), F.col("metadata.language").alias("language"))


@query("select_main_content", f"WITH {O.PAGES_MAIN} SELECT CAST(page_id AS VARCHAR) AS page_id, main_selector FROM pm")
def q_select_main_content(spark, sf):
    """H5: which element is the main content."""
    return raw_pages(spark, sf, fields=("content",)).select(_pid(), "main_selector")


@query("extract_text", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, text, CAST(length(text) AS BIGINT) AS text_length FROM pc
""")
def q_extract_text(spark, sf):
    """H6: cleaned main-content text (double entity decode, F1)."""
    raw = raw_pages(spark, sf, fields=("content",))
    return longs(raw.select(_pid(), F.col("content.text").alias("text"),
                            F.length("content.text").alias("text_length")))


@query("extract_headings", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS level, h1_raw AS text FROM pm
""")
def q_extract_headings(spark, sf):
    """H7: headings under the main content, document order."""
    raw = raw_pages(spark, sf, fields=("content",))
    return longs(each(raw.withColumn("page_id", _pid()), "content.headings", "page_id")
                 .select("page_id", (F.col("pos") + 1).alias("pos"), "x.level", "x.text"))


@query("extract_paragraphs", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(len(paras_raw) AS BIGINT) AS n_paragraphs,
       CAST(list_sum(list_transform(paras_raw, lambda t: length(t))) AS BIGINT) AS paragraph_chars,
       paras_raw[1] AS first_paragraph
FROM pm
""")
def q_extract_paragraphs(spark, sf):
    """H8: <p> texts longer than 10 characters (unclosed <p> contains the
    following ones)."""
    raw = raw_pages(spark, sf, fields=("content",))
    return longs(raw.select(_pid(), F.expr("size(content.paragraphs)").alias("n_paragraphs"),
                            F.expr("aggregate(content.paragraphs, 0, (a, t) -> a + length(t))").alias("paragraph_chars"),
                            F.expr("try_element_at(content.paragraphs, 1)").alias("first_paragraph")))


@query("extract_lists", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id,
       CAST(len(regexp_extract_all(CASE WHEN main_selector = 'article' THEN art ELSE bod END, '<[uo]l>')) AS BIGINT) AS n_lists,
       CAST(len(regexp_extract_all(CASE WHEN main_selector = 'article' THEN art ELSE bod END, '<li>')) AS BIGINT) AS n_items
FROM pm
""")
def q_extract_lists(spark, sf):
    """H9: ul/ol lists under the main content with their item counts."""
    raw = raw_pages(spark, sf, fields=("content",))
    return longs(raw.select(_pid(), F.expr("size(content.lists)").alias("n_lists"),
                            F.expr("aggregate(content.lists, 0, (a, l) -> a + size(l.items))").alias("n_items")))


@query("extract_page_domain", """
SELECT CAST(page_id AS VARCHAR) AS page_id,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS domain FROM pages
""")
def q_extract_page_domain(spark, sf):
    """Page domain (netloc) from the page url."""
    pages = table(spark, sf, "pages")
    return pages.select(_pid(), U.url_netloc("url").alias("domain"))


# ==========================================================================
# Tables and statistics (C1: A1-A3, W3)

@query("pages_table", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, url, title, CAST(length(text) AS BIGINT) AS text_length,
       CAST(len(paras) AS BIGINT) AS paragraph_count, CAST(1 AS BIGINT) AS heading_count,
       CAST(0 AS BIGINT) AS image_count, CAST(0 AS BIGINT) AS form_count,
       CAST(200 AS BIGINT) AS http_status_code, CAST(0 AS BIGINT) AS response_time_ms
FROM pc
""")
def q_pages_table(spark, sf):
    """A1: one row per page."""
    return longs(pages_table(facts(spark, sf)).drop("scraped_at"))


@query("headings_table", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, url, CAST(1 AS BIGINT) AS heading_number,
       CAST(1 AS BIGINT) AS heading_level, h1 AS heading_text FROM pc
""")
def q_headings_table(spark, sf):
    """Numbered headings."""
    return longs(headings_table(records(spark, sf, ("content",))))


@query("page_statistics", f"""
WITH {O.ANCHORS}, {O.PAGES_MAIN},
nl AS (SELECT page_id, count(DISTINCT abs_url) AS n FROM anc_rows GROUP BY page_id)
SELECT CAST(pc.page_id AS VARCHAR) AS page_id, pc.url, CAST(12 AS BIGINT) AS total_fields,
       CAST(length(text) AS BIGINT) AS content_length, CAST(len(paras) AS BIGINT) AS paragraphs_count,
       CAST(1 AS BIGINT) AS headings_count, CAST(coalesce(nl.n, 0) AS BIGINT) AS links_count,
       CAST(0 AS BIGINT) AS images_count, CAST(0 AS BIGINT) AS forms_count,
       CAST({O.words('text')} AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS character_count,
       CAST(1 AS BIGINT) AS pages_scraped, CAST(coalesce(nl.n, 0) AS BIGINT) AS links_found,
       CAST(0 AS BIGINT) AS images_found, CAST(1 AS BIGINT) AS headings_found,
       CAST(len(paras) AS BIGINT) AS paragraphs_found, CAST(0 AS BIGINT) AS forms_found
FROM pc LEFT JOIN nl ON nl.page_id = pc.page_id
""")
def q_page_statistics(spark, sf):
    """A2/A3: per-page statistics and run counters."""
    return longs(page_statistics(facts(spark, sf)))


# ==========================================================================
# Scalars over documents

_DOC_CTRL = "text || chr(7) || chr(9) || chr(160)"


@query("clean_text", f"""
SELECT doc_id, {O.clean(_DOC_CTRL)} AS cleaned,
       CAST(length({O.clean(_DOC_CTRL)}) AS BIGINT) AS cleaned_length
FROM documents
""")
def q_clean_text(spark, sf):
    """F1 on document text with control characters, a tab and NBSP appended."""
    d = table(spark, sf, "documents")
    raw = "concat(text, char(7), char(9), char(160))"
    return longs(d.select("doc_id", TX.clean_text(raw).alias("cleaned"),
                          F.expr(f"length({TX.clean_text_sql(raw)})").alias("cleaned_length")))


@query("word_count", f"""
SELECT doc_id, CAST({O.words('text')} AS BIGINT) AS word_count,
       CAST(length(text) AS BIGINT) AS char_length FROM documents
""")
def q_word_count(spark, sf):
    """Whitespace tokens and code points of each document."""
    d = table(spark, sf, "documents")
    return longs(d.select("doc_id", TX.word_count("text").alias("word_count"),
                          TX.char_length("text").alias("char_length")))


@query("truncate", """
SELECT doc_id,
       CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS t50,
       CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS t500
FROM documents
""")
def q_truncate(spark, sf):
    """first n characters plus '...'."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.truncate("text", 50).alias("t50"), TX.truncate("text", 500).alias("t500"))


@query("or_na", """
SELECT doc_id, coalesce(nullif(regexp_extract(text, '(https?://[^ ]+)', 1), ''), 'N/A') AS first_url
FROM documents
""")
def q_or_na(spark, sf):
    """the first URL mentioned in a document, or 'N/A'."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.or_na("regexp_extract(text, 'https?://[^ ]+', 0)").alias("first_url"))


# ==========================================================================
# Flat fixtures: images (F7, D2, W2) and links

from ..operators import flat as FL  # noqa: E402
from . import derived as DV  # noqa: E402


def _images_flat(spark, sf):
    rows = DV.part_images(spark, sf)
    deduped = FL.dedup_first_flat(rows, "src")
    return FL.normalize_images_flat(deduped, "src", "base_url")


@query("images_table", f"""
WITH {O.PART_IMAGES},
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, src ORDER BY pos) AS rn FROM pimg),
n AS (SELECT *, {O.resolve_simple('trim(src)', 'base_url')} AS abs_src FROM d WHERE rn = 1),
v AS (SELECT * FROM n WHERE abs_src LIKE 'http%' AND abs_src NOT LIKE '% %')
SELECT CAST(page_id AS VARCHAR) || '_img_' || CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS VARCHAR) AS image_id,
       CAST(page_id AS VARCHAR) AS page_id, abs_src AS image_src, alt AS image_alt,
       {O.netloc('abs_src')} != {O.netloc('base_url')} AS is_external
FROM v
""")
def q_images_table(spark, sf):
    """W2 (+D2, F7, P3, F5, F11) over image rows: first occurrence per src,
    resolved, valid ones numbered per page."""
    numbered = FL.number_valid_flat(_images_flat(spark, sf), "src", "base_url", number_col="n")
    return numbered.select(F.expr("concat(CAST(page_id AS STRING), '_img_', CAST(n AS STRING))").alias("image_id"),
                           _pid(), F.col("src").alias("image_src"), F.col("alt").alias("image_alt"), "is_external")


@query("normalize_images", f"""
WITH {O.PART_IMAGES},
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, src ORDER BY pos) AS rn FROM pimg),
n AS (SELECT *, {O.resolve_simple('trim(src)', 'base_url')} AS abs_src FROM d WHERE rn = 1)
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(count(*) AS BIGINT) AS image_count
FROM n WHERE abs_src LIKE 'http://%' OR abs_src LIKE 'https://%' GROUP BY page_id
""")
def q_normalize_images(spark, sf):
    """images kept by normalisation per page (the page table's
    image_count, counted before the URL validity filter — quirk Q4)."""
    return longs(_images_flat(spark, sf).groupBy(_pid()).agg(F.count(F.lit(1)).alias("image_count")))


@query("normalize_links", f"""
WITH {O.PART_LINKS},
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM plink),
s AS (SELECT *, trim(url) AS raw FROM d WHERE rn = 1),
k AS (SELECT * FROM s WHERE raw <> '' AND NOT regexp_matches(lower(raw), '^(#|javascript:|mailto:|tel:|data:|ftp:|file:)')),
n AS (SELECT *, CASE WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' THEN raw
                     WHEN lower(raw) LIKE 'http://%' AND {O.scheme('base_url')} = 'http' THEN 'http' || substr(raw, 5)
                     WHEN lower(raw) LIKE 'http://%' THEN raw
                     ELSE {O.origin('base_url')} || raw END AS link_url FROM k)
SELECT CAST(page_id AS VARCHAR) AS page_id,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS link_number,
       link_url, text AS link_text, {O.netloc('link_url')} != {O.netloc('base_url')} AS is_external
FROM n
""")
def q_normalize_links(spark, sf):
    """F6 (+P4, D1, P3, W1, F5) over link rows: dedup on the raw href before
    normalisation (so '/p/1' and '  /p/1' both survive), pseudo links
    dropped, upper-case schemes resolved as Python does."""
    rows = DV.part_links(spark, sf)
    deduped = FL.dedup_first_flat(rows, "url")
    normed = FL.normalize_links_flat(deduped, "url", "base_url")
    numbered = FL.number_valid_flat(normed, "url", "base_url", number_col="link_number")
    return longs(numbered.select(_pid(), "link_number", F.col("url").alias("link_url"),
                                 F.col("text").alias("link_text"), "is_external"))


# ==========================================================================
# URL scalars and request checks

@query("url_parts", f"""
WITH r AS ({O.REQUEST_URLS})
SELECT url, {O.scheme('trim(url)')} AS scheme, {O.netloc('trim(url)')} AS netloc FROM r
""")
def q_url_parts(spark, sf):
    """scheme and netloc of every request URL."""
    r = DV.request_urls(spark, sf)
    return r.select("url", U.url_scheme("btrim(url)").alias("scheme"), U.url_netloc("btrim(url)").alias("netloc"))


@query("url_join", f"""
WITH {O.ANCHORS}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(pos AS BIGINT) AS pos, abs_url AS joined FROM anc_rows
""")
def q_url_join(spark, sf):
    """every href of every page resolved against the page URL."""
    pages = table(spark, sf, "pages")
    hrefs = pages.select("page_id", "url", F.posexplode(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"))
                         .alias("p", "href"))
    return longs(hrefs.select(_pid(), (F.col("p") + 1).alias("pos"), U.url_join("url", "href").alias("joined")))


@query("is_valid_url", f"""
WITH {O.PART_LINKS}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(pos AS BIGINT) AS pos,
       (trim(url) LIKE 'http://%' OR trim(url) LIKE 'https://%' OR trim(url) LIKE 'HTTP://%') AND trim(url) NOT LIKE '% %' AS valid,
       trim(url) = '' OR regexp_matches(lower(trim(url)), '^(#|javascript:|mailto:|tel:|data:|ftp:|file:)') AS pseudo
FROM plink
""")
def q_is_valid_url(spark, sf):
    """Validity and pseudo-link test of every raw link href."""
    rows = DV.part_links(spark, sf)
    return longs(rows.select(_pid(), "pos", U.is_valid_url("url").alias("valid"),
                             U.skip_pseudo_link("url").alias("pseudo")))


@query("validate_request", f"""
WITH r AS ({O.REQUEST_URLS}), f AS (SELECT url, scraping_type, {O.REQUEST_FACTS} FROM r)
SELECT url, scraping_type, scrapable, suspicious, private,
       CASE WHEN NOT scrapable THEN 'Invalid URL format'
            WHEN scraping_type NOT IN ('static', 'dynamic', 'auto') THEN 'Invalid scraping type. Must be static, dynamic, or auto'
            WHEN private THEN 'Cannot scrape private or localhost URLs' ELSE '' END AS message,
       CAST(CASE WHEN scrapable AND scraping_type IN ('static', 'dynamic', 'auto') AND suspicious THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
FROM f
""")
def q_validate_request(spark, sf):
    """Scrapable, suspicious and private checks and the ordered
    request verdict for every page URL plus probe URLs."""
    r = DV.request_urls(spark, sf)
    v = r.select("url", "scraping_type", U.is_scrapable_url("url").alias("scrapable"),
                 U.is_suspicious_url("url").alias("suspicious"), U.is_private_url("url").alias("private"),
                 U.validate_request("url", "scraping_type").alias("v"))
    return longs(v.select("url", "scraping_type", "scrapable", "suspicious", "private",
                          F.col("v.message").alias("message"), F.size("v.warnings").alias("n_warnings")))


# ==========================================================================
# Gates (P1, P2, P10-P16, P19, P20, J1-J3, J5, A5, A7)

from ..operators import gates as G  # noqa: E402
from ..operators import runs as RN  # noqa: E402
from .scrape import gate_columns, scrape_pages  # noqa: E402

PROBE_KEYWORDS = ["zzz", "ción", "sch", "the"]
KEYWORD_TABLE = [("captcha", 1), ("verify", 2), ("robot", 3), ("human", 4), ("prove", 5),
                 ("ción", 6), ("sch", 7), ("the", 8)]


@query("captcha_by_text", f"""
WITH {O.DOC_TEXT}
SELECT CAST(page_id AS VARCHAR) AS page_id,
       {O.first_keyword('lower(doc_text)', O.GATE_WORDS)} AS gate_keyword,
       {O.first_keyword('lower(doc_text)', PROBE_KEYWORDS)} AS probe_keyword
FROM dt
""")
def q_captcha_by_text(spark, sf):
    """First keyword found in the page text, for the gate list and a
    probe list whose words do occur."""
    d = parse_dom(pages_of(spark, sf))
    return d.select(_pid(), F.expr(G.captcha_by_text_sql("dom.text", G.GATE_KEYWORDS)).alias("gate_keyword"),
                    F.expr(G.captcha_by_text_sql("dom.text", PROBE_KEYWORDS)).alias("probe_keyword"))


@query("gate_captcha", f"""
WITH {O.DOC_TEXT}, {O.FETCHED}
SELECT CAST(page_id AS VARCHAR) AS page_id, has_captcha, type, indicator FROM (
  SELECT page_id,
    CASE WHEN server LIKE '%cloudflare%' THEN true WHEN status = 200 THEN sel IS NOT NULL OR kw IS NOT NULL
         WHEN status IN (403, 429, 503) THEN true ELSE false END AS has_captcha,
    CASE WHEN server LIKE '%cloudflare%' THEN 'header' WHEN status = 200 AND sel IS NOT NULL THEN 'selector'
         WHEN status = 200 AND kw IS NOT NULL THEN 'text' WHEN status IN (403, 429, 503) THEN 'status' END AS type,
    CASE WHEN server LIKE '%cloudflare%' THEN 'server: cloudflare' WHEN status = 200 AND sel IS NOT NULL THEN sel
         WHEN status = 200 AND kw IS NOT NULL THEN kw WHEN status IN (403, 429, 503) THEN CAST(status AS VARCHAR) END AS indicator
  FROM (SELECT f.*, {O.first_keyword('lower(dt.doc_text)', O.GATE_WORDS)} AS kw,
               CASE WHEN regexp_matches(f.html, 'class="[^"]*captcha') THEN '[class*="captcha"]'
                    WHEN regexp_matches(f.html, 'id="[^"]*captcha') THEN '[id*="captcha"]' END AS sel
        FROM fp f JOIN dt ON dt.page_id = f.page_id))
""")
def q_gate_captcha(spark, sf):
    """Header → selectors/text (status 200) → status gate."""
    g = gate_columns(DV.fetched_pages(spark, sf))
    return g.select(_pid(), "captcha.has_captcha", "captcha.type", "captcha.indicator")


@query("classify_rendering", f"""
WITH {O.DOC_TEXT}, {O.FETCHED}
SELECT CAST(f.page_id AS VARCHAR) AS page_id,
  CASE WHEN f.status != 200 OR {O.markers('lower(f.html)', O.MARKERS)} OR dt.strip_len < 100
       THEN 'dynamic' ELSE 'static' END AS rendering,
  CASE WHEN f.url LIKE '%/en/%' THEN 'static' WHEN f.url LIKE '%/fr/%' THEN 'dynamic'
       WHEN f.status != 200 OR {O.markers('lower(f.html)', O.MARKERS)} OR dt.strip_len < 100
       THEN 'dynamic' ELSE 'static' END AS route
FROM fp f JOIN dt ON dt.page_id = f.page_id
""")
def q_classify_rendering(spark, sf):
    """Static-or-dynamic detection and routing by request type."""
    from ..operators.extract import text_strip_length_sql
    fp = DV.fetched_pages(spark, sf).withColumn("_marked", F.expr(G.markup_markers_sql("html")))
    raw = parse_dom(fp, tags=frozenset()).withColumn("_strip", F.expr(text_strip_length_sql("dom")))
    rtype = "CASE WHEN url LIKE '%/en/%' THEN 'static' WHEN url LIKE '%/fr/%' THEN 'dynamic' ELSE 'auto' END"
    r = raw.select("page_id", "url", F.expr(G.classify_rendering_sql("_marked", "http_status_code", "_strip")).alias("rendering"))
    return r.select(_pid(), "rendering", F.expr(G.route_by_type_sql(rtype, "rendering")).alias("route"))


@query("robots_allowed", f"""
WITH u AS (SELECT page_id, url, {O.netloc('url')} AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) AS rest FROM pages)
SELECT CAST(page_id AS VARCHAR) AS page_id, url,
  CASE WHEN host LIKE 'blog.%' THEN true WHEN host LIKE 'www.%' THEN NOT starts_with(rest, '/en/')
       ELSE starts_with(rest, '/fr/1') OR NOT starts_with(rest, '/fr/') END AS allowed,
  CASE WHEN host LIKE 'blog.%' OR host LIKE 'www.%' THEN 1.0 ELSE 2.0 END AS crawl_delay
FROM u
""")
def q_robots_allowed(spark, sf):
    """Robots.txt verdict and crawl delay for every page URL."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    out = G.robots_allowed(pages, DV.robots_files(spark, sf), "url")
    return out.select(_pid(), "url", "allowed", "crawl_delay")


@query("robots_as_of", """
WITH req AS (SELECT event_id AS request_id, user_id AS host, ts FROM events WHERE event_type = 'click'),
snap AS (SELECT event_id AS snapshot_id, user_id AS host, ts FROM events WHERE event_type = 'signup')
SELECT req.request_id,
       CASE WHEN snap.ts IS NOT NULL AND epoch_us(req.ts) - epoch_us(snap.ts) < 3600000000
            THEN strftime(snap.ts, '%Y-%m-%d %H:%M:%S.%f') END AS snapshot_ts
FROM req ASOF LEFT JOIN snap ON req.host = snap.host AND req.ts >= snap.ts
""")
def q_robots_as_of(spark, sf):
    """Newest robots snapshot no older than the TTL for each request
    (clicks = requests, signups = snapshots, host = user)."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    req = ev.filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("host"), "ts")
    snap = ev.filter("event_type = 'signup'").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("snapshot_id"))
    out = G.robots_as_of(req, snap)
    return out.select("request_id", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("snapshot_ts"))


@query("keyword_semi_join", f"""
WITH {O.DOC_TEXT},
kw AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {o})" for k, o in KEYWORD_TABLE)}) t(keyword, ord)),
hits AS (SELECT dt.page_id, kw.keyword, kw.ord FROM dt JOIN kw ON contains(lower(dt.doc_text), kw.keyword))
SELECT CAST(dt.page_id AS VARCHAR) AS page_id, arg_min(hits.keyword, hits.ord) AS first_keyword,
       CAST(count(hits.keyword) AS BIGINT) AS n_keywords
FROM dt LEFT JOIN hits ON hits.page_id = dt.page_id GROUP BY dt.page_id
""")
def q_keyword_semi_join(spark, sf):
    """Table-driven keyword gate — first keyword by priority and the
    number of keywords found in each page's text."""
    d = parse_dom(pages_of(spark, sf)).select(_pid(), F.col("dom.text").alias("text"))
    kw = spark.createDataFrame(KEYWORD_TABLE, "keyword string, ord int")
    return longs(G.keyword_first_match(d, kw, "page_id", "text"))


@query("keyword_table_join", """
WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS keyword FROM benchmark),
kw AS (SELECT keyword, length(keyword) AS ord FROM w WHERE length(keyword) > 3),
hits AS (SELECT d.doc_id, kw.keyword, kw.ord FROM documents d JOIN kw ON contains(lower(d.text), kw.keyword)),
f AS (SELECT doc_id, count(*) AS n, min(struct_pack(o := ord, w := keyword)) AS first FROM hits GROUP BY doc_id)
SELECT d.doc_id, f.first.w AS first_keyword, coalesce(f.n, 0) AS n_keywords FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
""")
def q_keyword_table_join(spark, sf):
    """J5 / A5 with a keyword table that is joined: every word of more than three
    characters of the benchmark items (shorter ones first), in every document."""
    word = F.explode(F.split(F.lower("text"), " "))
    kw = table(spark, sf, "benchmark").select(word.alias("keyword")).distinct().filter("length(keyword) > 3") \
        .select("keyword", F.length("keyword").alias("ord"))
    return G.keyword_first_match(table(spark, sf, "documents"), kw, "doc_id", "text", in_plan=0)


@query("gate_pipeline", f"""
WITH {O.DOC_TEXT}, {O.FETCHED}, {O.PAGES_MAIN},
u AS (SELECT page_id, {O.netloc('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) AS rest FROM pages),
g AS (SELECT f.page_id, f.status, f.server,
             CASE WHEN u.host LIKE 'blog.%' THEN true WHEN u.host LIKE 'www.%' THEN NOT starts_with(u.rest, '/en/')
                  ELSE starts_with(u.rest, '/fr/1') OR NOT starts_with(u.rest, '/fr/') END AS allowed,
             {O.first_keyword('lower(dt.doc_text)', O.GATE_WORDS)} AS kw,
             {O.first_keyword('lower(dt.doc_text)', O.STATIC_WORDS)} AS kw6,
             pm.text AS main_text
      FROM fp f JOIN u ON u.page_id = f.page_id JOIN dt ON dt.page_id = f.page_id JOIN pc pm ON pm.page_id = f.page_id)
SELECT CAST(page_id AS VARCHAR) AS page_id,
       CASE WHEN e IS NULL THEN 'success' ELSE 'error' END AS status, e AS error
FROM (SELECT page_id, CASE WHEN NOT allowed THEN '{O.MSG_ROBOTS}'
        WHEN server LIKE '%cloudflare%' OR (status = 200 AND kw IS NOT NULL) OR status IN (403, 429, 503) THEN '{O.MSG_CAPTCHA}'
        WHEN status >= 400 OR kw6 IS NOT NULL OR main_text = '' THEN '{O.MSG_NO_DATA}' END AS e FROM g)
""")
def q_gate_pipeline(spark, sf):
    """Robots → captcha → fetch → content → validation, first
    failing gate names the error."""
    out = scrape_pages(DV.fetched_pages(spark, sf), RUN_TS, DV.robots_files(spark, sf))
    return out.select(_pid(), "status", "error")


@query("gate_outcomes", f"""
WITH {O.DOC_TEXT}, {O.FETCHED}, {O.PAGES_MAIN},
u AS (SELECT page_id, {O.netloc('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) AS rest FROM pages),
g AS (SELECT f.page_id, f.status, f.server,
             CASE WHEN u.host LIKE 'blog.%' THEN true WHEN u.host LIKE 'www.%' THEN NOT starts_with(u.rest, '/en/')
                  ELSE starts_with(u.rest, '/fr/1') OR NOT starts_with(u.rest, '/fr/') END AS allowed,
             {O.first_keyword('lower(dt.doc_text)', O.GATE_WORDS)} AS kw,
             {O.first_keyword('lower(dt.doc_text)', O.STATIC_WORDS)} AS kw6, pm.text AS main_text
      FROM fp f JOIN u ON u.page_id = f.page_id JOIN dt ON dt.page_id = f.page_id JOIN pc pm ON pm.page_id = f.page_id),
e AS (SELECT CASE WHEN NOT allowed THEN '{O.MSG_ROBOTS}'
        WHEN server LIKE '%cloudflare%' OR (status = 200 AND kw IS NOT NULL) OR status IN (403, 429, 503) THEN '{O.MSG_CAPTCHA}'
        WHEN status >= 400 OR kw6 IS NOT NULL OR main_text = '' THEN '{O.MSG_NO_DATA}' END AS error FROM g)
SELECT CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error, CAST(count(*) AS BIGINT) AS pages
FROM e GROUP BY ALL
""")
def q_gate_outcomes(spark, sf):
    """Pages per gate outcome."""
    out = scrape_pages(DV.fetched_pages(spark, sf), RUN_TS, DV.robots_files(spark, sf))
    return longs(RN.gate_outcomes(out.select("status", "error")).drop("share"))


@query("scrape_pages", f"""
WITH {O.ANCHORS}, {O.DOC_TEXT}, {O.FETCHED}, {O.PAGES_MAIN},
nl AS (SELECT page_id, count(DISTINCT abs_url) AS n FROM anc_rows GROUP BY page_id),
u AS (SELECT page_id, {O.netloc('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) AS rest,
             CASE WHEN url LIKE '%/en/%' THEN 'static' WHEN url LIKE '%/fr/%' THEN 'dynamic'
                  WHEN url LIKE '%/de/%' THEN 'bogus' ELSE 'auto' END AS scraping_type FROM pages),
g AS (SELECT f.page_id, f.status, f.server, u.scraping_type, nl.n AS links,
             CASE WHEN u.host LIKE 'blog.%' THEN true WHEN u.host LIKE 'www.%' THEN NOT starts_with(u.rest, '/en/')
                  ELSE starts_with(u.rest, '/fr/1') OR NOT starts_with(u.rest, '/fr/') END AS allowed,
             CASE WHEN u.scraping_type IN ('static', 'dynamic') THEN u.scraping_type
                  WHEN {O.markers('lower(f.html)', O.MARKERS)} OR dt.strip_len < 100 THEN 'dynamic' ELSE 'static' END AS way,
             {O.first_keyword('lower(dt.doc_text)', ['captcha', 'recaptcha', 'hcaptcha', 'verify', 'verification', 'prove', 'robot', 'human'])} AS kw,
             pm.text AS main_text
      FROM fp f JOIN u ON u.page_id = f.page_id JOIN dt ON dt.page_id = f.page_id JOIN pc pm ON pm.page_id = f.page_id
           LEFT JOIN nl ON nl.page_id = f.page_id),
e AS (SELECT *, CASE WHEN scraping_type = 'bogus' THEN 'Invalid scraping type. Must be static, dynamic, or auto'
        WHEN NOT allowed THEN 'Robots.txt disallows scraping'
        WHEN server LIKE '%cloudflare%' OR status IN (403, 429, 503) THEN 'CAPTCHA detected - scraping blocked'
        WHEN status >= 400 THEN 'Scraping failed - no data retrieved' END AS early FROM g),
f AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN kw IS NOT NULL THEN 'CAPTCHA detected - scraping blocked'
        WHEN main_text = '' THEN 'Scraping failed - no data retrieved' END AS error FROM e)
SELECT CAST(page_id AS VARCHAR) AS page_id, scraping_type, CASE WHEN early IS NULL THEN way END AS route,
       CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN CAST(coalesce(links, 0) AS BIGINT) END AS links
FROM f
""")
def q_scrape_pages(spark, sf):
    """C2 with a request type per page (P9, P16): rejected rows are never
    parsed, the others take their own dialect."""
    rtype = F.expr("CASE WHEN url LIKE '%/en/%' THEN 'static' WHEN url LIKE '%/fr/%' THEN 'dynamic' "
                   "WHEN url LIKE '%/de/%' THEN 'bogus' ELSE 'auto' END")
    out = scrape_pages(DV.fetched_pages(spark, sf).withColumn("scraping_type", rtype), RUN_TS, DV.robots_files(spark, sf))
    return out.select(_pid(), "scraping_type", "route", "status", "error",
                      F.when(F.col("error").isNull(), F.size("link_rows")).cast("long").alias("links"))


@query("validate_raw", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, url <> '' AS valid,
       (text <> '' OR h1_raw <> '' OR len(paras_raw) > 0) AS has_content,
       concat_ws('; ', CASE WHEN text = '' AND len(paras_raw) = 0 THEN 'No content extracted' END,
                       CASE WHEN title = '' THEN 'No title found' END) AS warnings
FROM pc
""")
def q_validate_raw(spark, sf):
    """Content check and validation (errors and warnings)."""
    raw = raw_pages(spark, sf)
    from ..operators.process import has_content_sql, validate_raw_sql
    v = raw.select(_pid(), F.expr(validate_raw_sql("url", "content", "metadata")).alias("v"),
                   F.expr(has_content_sql("url", "content")).alias("has_content"))
    return v.select("page_id", F.col("v.valid").alias("valid"), "has_content",
                    F.expr("concat_ws('; ', v.warnings)").alias("warnings"))


# ==========================================================================
# Run analytics (A4, W4-W6, T1, T2), sessions (X2, X3, P17), unions

@query("host_rollup", f"""
WITH {O.ANCHORS},
nl AS (SELECT page_id, count(DISTINCT abs_url) AS n FROM anc_rows GROUP BY page_id),
p AS (SELECT pages.page_id, {O.netloc('url')} AS host, coalesce(nl.n, 0) AS n FROM pages LEFT JOIN nl ON nl.page_id = pages.page_id)
SELECT host, CAST(count(*) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS links, CAST(0 AS BIGINT) AS external_links,
       CAST(0.0 AS DOUBLE) AS avg_response_ms
FROM p GROUP BY ROLLUP (host)
""")
def q_host_rollup(spark, sf):
    """A4: pages, links, external links, mean response time per host and in
    total (rollup)."""
    return longs(RN.host_rollup(records(spark, sf, ("links",))))


@query("session_durations", """
WITH ev AS (SELECT * FROM events),
lines AS (
  SELECT event_id * 2 AS line_no, date_trunc('millisecond', ts) AS ts, 'https://u' || CAST(user_id AS VARCHAR) || '.example/' AS url,
         true AS is_start, CAST(event_id AS VARCHAR) AS session_id FROM ev
  UNION ALL
  SELECT event_id * 2 + 1, date_trunc('millisecond', make_timestamp(epoch_us(ts) + CAST(value * 1000000 AS BIGINT))),
         'https://u' || CAST(user_id AS VARCHAR) || '.example/', false, NULL FROM ev WHERE event_type <> 'error'),
w AS (SELECT *, lead(ts) OVER (PARTITION BY url ORDER BY ts, line_no) AS nts,
                lead(is_start) OVER (PARTITION BY url ORDER BY ts, line_no) AS nstart FROM lines)
SELECT session_id, url, CASE WHEN nts IS NOT NULL AND NOT nstart THEN 'completed' ELSE 'failed' END AS outcome,
       CASE WHEN nts IS NOT NULL AND NOT nstart THEN (epoch_us(nts) - epoch_us(ts)) // 1000 END AS duration_ms
FROM w WHERE is_start
""")
def q_session_durations(spark, sf):
    """S4 + W4: parse run-log text lines, then start → finish per run."""
    logs = RN.parse_run_logs(DV.run_log_lines(spark, sf))
    d = RN.session_durations(logs)
    return d.select("session_id", "url", "outcome",
                    F.expr("(unix_micros(finished_at) - unix_micros(started_at)) div 1000").alias("duration_ms"))


@query("politeness_audit", """
WITH r AS (SELECT event_id AS request_id, 'u' || CAST(user_id AS VARCHAR) AS host, ts FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY host ORDER BY ts, request_id) AS prev_ts FROM r)
SELECT request_id, (epoch_us(ts) - epoch_us(prev_ts)) // 1000 AS gap_ms,
       coalesce(epoch_us(ts) - epoch_us(prev_ts) < 3600000000, false) AS too_fast
FROM l
""")
def q_politeness_audit(spark, sf):
    """Gap to the previous request on the same host (events as
    requests, host = user) against a one-hour politeness delay."""
    ev = table(spark, sf, "events")
    req = ev.select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
                    F.col("ts").cast("timestamp").alias("ts"))
    a = RN.politeness_audit(req, min_gap_sec=3600.0)
    return a.select("request_id", F.expr("(unix_micros(ts) - unix_micros(prev_ts)) div 1000").alias("gap_ms"),
                    "too_fast")


@query("latest_snapshot", f"""
WITH r AS (SELECT CAST(page_id AS VARCHAR) AS page_id, {O.netloc('url')} AS host,
                  TIMESTAMP '2026-01-01 00:00:00' + to_hours(page_id) AS scraped_at FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY scraped_at DESC, page_id) AS rn FROM r)
SELECT host, page_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM k WHERE rn = 1
""")
def q_latest_snapshot(spark, sf):
    """The newest run per host."""
    runs = DV.page_runs(spark, sf).select("page_id", U.url_netloc("url").alias("host"), "scraped_at")
    best = RN.latest_snapshot(runs, key="host")
    return best.select("host", "page_id", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("recent_runs", """
SELECT CAST(page_id AS VARCHAR) AS page_id, url,
       strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM pages ORDER BY pages.page_id DESC LIMIT 5
""")
def q_recent_runs(spark, sf):
    """The five newest runs (top-k is the feature)."""
    runs = DV.page_runs(spark, sf).select("page_id", "url", "scraped_at")
    top = RN.recent_runs(runs, 5)
    return top.select("page_id", "url", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("first_record_preview", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id,
       CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview
FROM pc ORDER BY CAST(page_id AS VARCHAR) LIMIT 1
""")
def q_first_record_preview(spark, sf):
    """First record with a 500-character text preview."""
    first = RN.first_record(scan_pages(spark, f"{sf}/pages.parquet"))      # one page is parsed
    rec = process_records(extract_raw(first), RUN_TS).select("page_id", F.col("content.text").alias("text"))
    return RN.first_record_preview(rec, "text", 500)


_SESS = """
s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS seq, value AS progress, event_type AS step,
             CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END AS status
      FROM events),
st AS (SELECT session_id, progress, step, status, max(ts) OVER (PARTITION BY session_id) AS updated_at,
              row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn FROM s)
"""


@query("session_state", f"""
WITH {_SESS}
SELECT session_id, progress, step, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM st WHERE rn = 1
""")
def q_session_state(spark, sf):
    """X2 (batch): latest progress, step and status per session."""
    st = RN.session_state(DV.sessions(spark, sf))
    return st.select("session_id", "progress", "step", "status",
                     F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


@query("active_sessions", f"""
WITH {_SESS}
SELECT session_id, status, {O.status_badge('status')} AS badge, upper(left(status, 1)) || lower(substr(status, 2)) AS label,
       strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated
FROM st WHERE rn = 1 AND status NOT IN ('completed', 'error', 'stopped')
""")
def q_active_sessions(spark, sf):
    """P17 with F16/F17 display columns: sessions still running."""
    from ..functions import text as T2
    act = RN.active_sessions(RN.session_state(DV.sessions(spark, sf)))
    return act.select("session_id", "status", T2.status_badge("status").alias("badge"),
                      T2.title_case("status").alias("label"), T2.format_timestamp("updated_at").alias("updated"))


@query("stop_sessions", f"""
WITH {_SESS},
stops AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_type = 'view' AND value > 40)
SELECT st.session_id, 'stopped' AS status FROM st JOIN stops ON stops.session_id = st.session_id
WHERE rn = 1 AND st.status NOT IN ('completed', 'error', 'stopped')
""")
def q_stop_sessions(spark, sf):
    """X3 (batch): stop requests end active sessions; unknown ids ignored."""
    st = RN.session_state(DV.sessions(spark, sf))
    stops = table(spark, sf, "events").filter("event_type = 'view' AND value > 40") \
        .select(F.col("user_id").cast("string").alias("session_id"))
    return RN.stop_sessions(st, stops).select("session_id", "status")


@query("flatten_records", f"""
WITH {O.ANCHORS}, {O.PAGES_MAIN},
dl AS (SELECT *, row_number() OVER (PARTITION BY page_id, abs_url ORDER BY pos) AS rn FROM anc_rows),
nl AS (SELECT page_id, count(DISTINCT abs_url) AS n FROM anc_rows GROUP BY page_id),
lk AS (SELECT url, 'link' AS record_type, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS link_number,
              abs_url AS link_url, {O.strip('atext')} AS link_text, '' AS link_title, false AS is_external FROM dl WHERE rn = 1),
hd AS (SELECT url, 'heading' AS record_type, CAST(1 AS BIGINT) AS heading_number, CAST(1 AS BIGINT) AS heading_level, h1 AS heading_text FROM pc),
pg AS (SELECT pc.url, CAST(NULL AS VARCHAR) AS record_type, title, text AS text_content, CAST(len(paras) AS BIGINT) AS paragraphs_count,
              CAST(1 AS BIGINT) AS headings_count, CAST(coalesce(nl.n, 0) AS BIGINT) AS links_count,
              CAST(0 AS BIGINT) AS images_count, CAST(0 AS BIGINT) AS forms_count, CAST(NULL AS VARCHAR) AS description,
              'static' AS scraping_method
       FROM pc LEFT JOIN nl ON nl.page_id = pc.page_id)
SELECT * FROM lk UNION ALL BY NAME SELECT * FROM hd UNION ALL BY NAME SELECT * FROM pg
""")
def q_flatten_records(spark, sf):
    """D3: one heterogeneous record set (page, link and heading rows keyed
    by url), each page parsed once."""
    from ..sources.files import flatten_records
    return longs(flatten_records(records(spark, sf)).drop("scraped_at"))


@query("union_runs", f"""
WITH {O.PAGES_MAIN}
SELECT CAST(page_id AS VARCHAR) AS page_id, url, title, CAST(200 AS BIGINT) AS http_status_code, 'new' AS run FROM pc
UNION ALL
SELECT CAST(page_id AS VARCHAR), url, title, CAST(NULL AS BIGINT), 'old' FROM pc
""")
def q_union_runs(spark, sf):
    """Bag union of a new-schema run with an old-schema run (the
    two extra columns missing → NULL)."""
    from ..sources.files import union_runs
    p = staged(pages_table(facts(spark, sf)), "union-runs")       # parsed once for both runs
    new = p.select("page_id", "url", "title", "http_status_code", F.lit("new").alias("run"))
    old = p.select("page_id", "url", "title", F.lit("old").alias("run"))
    return longs(union_runs([new, old]).select("page_id", "url", "title", "http_status_code", "run"))


@query("run_file_name", """
SELECT CAST(page_id AS VARCHAR) AS page_id,
       'pages_' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1) || '_' ||
       strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(page_id), '%Y%m%d_%H%M%S') AS file_name,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1) AS host_part
FROM pages
""")
def q_run_file_name(spark, sf):
    """Run file name per table, host and time, and the host part
    parsed back out of it."""
    from ..sources.files import parse_run_file_name_sql, run_file_name_sql
    runs = DV.page_runs(spark, sf).select("page_id", U.url_host("url").alias("host"), "scraped_at")
    named = runs.select("page_id", F.expr(run_file_name_sql("'pages'", "host", "scraped_at")).alias("file_name"))
    return named.select("page_id", "file_name", F.expr(parse_run_file_name_sql("file_name")).alias("host_part"))


# ==========================================================================
# Streaming (X1, X4): the tables that a drained stream has written

@query("stream_process", f"""
WITH {O.ANCHORS}, {O.DOC_TEXT}, {O.PAGES_MAIN},
u AS (SELECT page_id, {O.netloc('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) AS rest FROM pages),
ok AS (SELECT u.page_id FROM u JOIN dt ON dt.page_id = u.page_id JOIN pc ON pc.page_id = u.page_id
       WHERE pc.text <> '' AND {O.first_keyword('lower(dt.doc_text)', ['captcha', 'verify', 'verification', 'prove', 'robot', 'human'])} IS NULL
         AND CASE WHEN u.host LIKE 'blog.%' THEN true WHEN u.host LIKE 'www.%' THEN NOT starts_with(u.rest, '/en/')
                  ELSE starts_with(u.rest, '/fr/1') OR NOT starts_with(u.rest, '/fr/') END),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, abs_url ORDER BY pos) AS rn FROM anc_rows)
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS link_number,
       abs_url AS link_url, {O.strip('atext')} AS link_text, '' AS link_title, false AS is_external
FROM d WHERE rn = 1 AND page_id IN (SELECT page_id FROM ok)
""")
def q_stream_process(spark, sf):
    """The scrape job run as a Structured Streaming query over the page
    files (availableNow), writing the run tables per micro-batch; returns
    the links table it wrote."""
    import uuid
    from ..session import checkpoint_path
    from ..streaming.stream import read_page_stream, stream_process, table_glob
    out = checkpoint_path(spark, f"stream-out-{uuid.uuid4().hex[:12]}")
    stream = read_page_stream(spark, table_glob(f"{sf}/pages.parquet"))
    q = stream_process(stream, out, RUN_TS, DV.robots_files(spark, sf))
    q.awaitTermination()
    return longs(spark.read.parquet(f"{out}/links").drop("batch_id", "scraped_at"))


@query("stream_session_state", """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS seq, value AS progress, event_type AS step,
             CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
             event_type = 'click' AND value > 60 AS is_stop FROM events),
st AS (SELECT a.session_id, a.ts AS stop_ts, max(struct_pack(ts := b.ts, seq := b.seq, progress := b.progress, step := b.step, status := b.status)) AS e
       FROM (SELECT DISTINCT session_id, ts FROM s WHERE is_stop) a JOIN s b ON b.session_id = a.session_id AND b.ts <= a.ts
       GROUP BY ALL),
hit AS (SELECT session_id, arg_min(e, stop_ts) AS e, min(stop_ts) AS stop_ts FROM st WHERE e.status = 'running' GROUP BY session_id),
fin AS (SELECT session_id, max(struct_pack(ts := ts, seq := seq, progress := progress, step := step, status := status)) AS e FROM s GROUP BY session_id)
SELECT fin.session_id, coalesce(hit.e.progress, fin.e.progress) AS progress, coalesce(hit.e.step, fin.e.step) AS step,
       CASE WHEN hit.session_id IS NULL THEN fin.e.status ELSE 'stopped' END AS status,
       strftime(coalesce(hit.stop_ts, fin.e.ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM fin LEFT JOIN hit ON hit.session_id = fin.session_id
""")
def q_stream_session_state(spark, sf):
    """X2 + X3 as a stream: session events and stop requests in one keyed
    state (stops: clicks of a high value)."""
    from ..streaming.stream import run_updates, stream_session_state, table_glob
    schema = table(spark, sf, "events").schema
    read = lambda: spark.readStream.schema(schema).parquet(table_glob(f"{sf}/events.parquet")) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END")
    sid = F.col("user_id").cast("string").alias("session_id")
    events = read().select(sid, "ts", F.col("event_id").alias("seq"), F.col("value").alias("progress"),
                           F.col("event_type").alias("step"), status.alias("status"))
    stops = read().filter("event_type = 'click' AND value > 60").select(sid, "ts")
    out = run_updates(stream_session_state(events, stops), "stream-sessions", "session_id")
    return out.select("session_id", "progress", "step", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


@query("robots_refresh", """
WITH RECURSIVE e AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS host, ts FROM events),
due(host, ts) AS (
  SELECT host, min(ts) FROM e GROUP BY host
  UNION ALL
  SELECT host, nxt FROM (SELECT d.host, (SELECT min(e.ts) FROM e WHERE e.host = d.host AND e.ts >= d.ts + INTERVAL 1 HOUR) AS nxt FROM due d)
  WHERE nxt IS NOT NULL)
SELECT host, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM due
""")
def q_robots_refresh(spark, sf):
    """Requests at which a host's robots.txt is fetched again, one TTL after
    the last (event stream: host = user, event time = ts)."""
    from ..streaming.stream import robots_refresh, run_to_the_end, table_glob
    ev = spark.readStream.schema(table(spark, sf, "events").schema).parquet(table_glob(f"{sf}/events.parquet"))
    req = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
                    F.col("ts").cast("timestamp").alias("ts"))
    path = run_to_the_end(req, robots_refresh, "robots-refresh", "host")
    return spark.read.parquet(path).select("host", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


# ==========================================================================
# Meta, Open Graph, forms and frameworks on enriched pages

_ENRICHED = """
ep AS (SELECT page_id, url, regexp_extract(html, 'lang="([^"]*)"', 1) AS lang FROM pages)
"""


@query("extract_meta", f"""
WITH {_ENRICHED}
SELECT CAST(page_id AS VARCHAR) AS page_id, 'd-' || lang AS description, lang AS og_title,
       ' d-' || lang || ' ' AS description_dynamic, true AS has_react
FROM ep
""")
def q_extract_meta(spark, sf):
    """Meta description (static: first, stripped; dynamic:
    last non-empty, as written), og:title (last wins) and DOM framework
    markers."""
    from ..operators.extract import frameworks_sql, meta_sql, open_graph_sql
    parsed = parse_dom(DV.enriched_pages(spark, sf))        # one parse for both dialects
    return parsed.select(
        _pid(), F.expr(meta_sql("dom", "description")).alias("description"),
        F.expr(f"{open_graph_sql('dom')}['og:title']").alias("og_title"),
        F.expr(meta_sql("dom", "description", "dynamic")).alias("description_dynamic"),
        F.expr(f"coalesce({frameworks_sql('dom')}['react'], false)").alias("has_react"))


@query("extract_forms", f"""
WITH {_ENRICHED}
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(1 AS BIGINT) AS n_forms, url AS action, 'post' AS method,
       'input,select,textarea' AS field_types, 'q,s,t' AS field_names, CAST(1 AS BIGINT) AS n_required,
       CAST(2 AS BIGINT) AS n_options, 'a:A:true,:B:false' AS options
FROM ep
""")
def q_extract_forms(spark, sf):
    """Forms (action = page url when missing, lower-cased method),
    their fields (type defaults to the tag name) and select options."""
    raw = extract_raw(DV.enriched_pages(spark, sf))
    f = F.expr("forms[0]")
    return longs(raw.select(
        _pid(), F.size("forms").alias("n_forms"), f["action"].alias("action"), f["method"].alias("method"),
        F.expr("array_join(transform(forms[0].fields, x -> x.type), ',')").alias("field_types"),
        F.expr("array_join(transform(forms[0].fields, x -> x.name), ',')").alias("field_names"),
        F.expr("size(filter(forms[0].fields, x -> x.required))").alias("n_required"),
        F.expr("size(forms[0].fields[1].options)").alias("n_options"),
        F.expr("array_join(transform(forms[0].fields[1].options, o -> concat_ws(':', o.value, o.text, "
               "CAST(o.selected AS STRING))), ',')").alias("options")))


from . import io_queries, rich  # noqa: E402

for _more in (rich, io_queries):
    QUERIES.update(_more.QUERIES)
    ORACLE.update(_more.ORACLE)
