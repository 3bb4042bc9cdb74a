"""Queries over enriched pages: every page of the table becomes a page with
all element kinds (both dialects differ on it), addressed by its id.

``RICH`` builds the markup from the page id alone, so the expected rows are
written out in the SQL, independently of the extractors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators.dom import parse_dom
from ..operators.extract import dom_to_facts, dom_to_raw, extract_raw, select_texts_sql
from ..operators.process import errors_table, framework_counts, images_table, page_children, page_children_local, \
    page_facts, pages_table, process_records, run_summary, write_bucketed
from ..operators.runs import host_rollup
from ..session import checkpoint_path, staged
from ..sources.pages import TASK_BYTES, spread_by_bytes

RUN_TS = "2026-01-01 00:00:00"
FILLER = "A long line of words about nothing much, told at length and without any hurry, so that the main part is long. " * 2

#: Pieces of the page; ``@`` stands for the page id.
RICH = [
    '<html lang="xx"><head><title> T  &amp;\t@ </title><meta name="description" content=" d@ ">',
    '<meta name="keywords" content="k1"><meta name="keywords" content="k2"><meta name="author" content="a@">',
    '<meta name="robots" content="noindex"><meta name="viewport" content="w"><meta property="og:title" content="o1">',
    '<meta property="og:title" content="o@"><meta property="og:type" content="t"><meta name="og:site" content="s">',
    '</head><body ng-app>#<main><h2 id="i2" class="a  b">Two  @</h2><h1>One</h1><h3> Three </h3><h6>Six</h6>',
    f'<p>  </p><p>short</p><p>{FILLER}</p><p>Paragraph\t number @</p>',
    '<ol><li>z</li></ol><ul><li>x@<ul><li>y</li></ul></li></ul>',
    '<a href="/a@" title="tt" target="_blank"> link one </a><a href="https://ext.example/@">ext</a>',
    '<a href="mailto:x@y">m</a><a href="#f">frag</a><a href="/a@">dup</a><a href="q r">space</a><a>none</a>',
    '<img src="/i@.png" alt="al" title="ti"><img src="https://cdn.example/x.png"><img src="data:zz">',
    '<img src="/i@.png" alt="dup"><img alt="nosrc"></main><form action="/go@" method="POST" id="f1">',
    '<input name="q" required placeholder="ph"><select name="s"><option> A </option><option value="b">B</option></select>',
    '<textarea name="t"></textarea></form><form class="g"><input type="CHECKBOX"></form></body></html>',
]


def rich_pages(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url, html: the enriched page of every page id."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id")
    extra = ("CASE page_id % 5 WHEN 0 THEN '<div class=\"g-recaptcha\"></div>' "
             "WHEN 1 THEN '<iframe src=\"https://hcaptcha.com/x\"></iframe>' "
             "WHEN 2 THEN '<div id=\"my-captcha-box\"></div>' ELSE '' END")
    react = "CASE WHEN page_id % 2 = 0 THEN '<i data-reactroot></i>' ELSE '' END"
    body = "".join(RICH).replace("x@y", "x\x01y").replace("'", "\\'")
    html = (f"replace(replace(replace('{body}', '@', CAST(page_id AS STRING)), '\x01', '@'), "
            f"'ng-app>#', concat('ng-app>', {extra}, {react}))")
    url = "concat('https://h', CAST(page_id % 7 AS STRING), '.example/d/p', CAST(page_id AS STRING))"
    return spread_by_bytes(pages.select("page_id", F.expr(url).alias("url"), F.expr(html).alias("html")), TASK_BYTES)


_R = """r AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'https://h' || (page_id % 7) || '.example' AS origin,
           'https://h' || (page_id % 7) || '.example/d/p' || page_id AS base FROM pages)"""
_LONG = FILLER.strip()

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = f"WITH {_R}\n{sql.strip()}"
        return fn
    return deco


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def _both(spark, sf, pick) -> DataFrame:
    """One parse (staged), both dialects; ``pick`` selects from the raw records."""
    parsed = staged(parse_dom(rich_pages(spark, sf)), "dom")
    rows = [pick(dom_to_raw(parsed, mode)).withColumn("mode", F.lit(mode)) for mode in ("static", "dynamic")]
    return _long(rows[0].unionByName(rows[1]))


def _pid():
    return F.col("page_id").cast("string").alias("page_id")


@query("extract_meta_full", """
SELECT id AS page_id, 'static' AS mode, 'T  & ' || id AS title, 'd' || id AS description, 'k1' AS keywords, 'a' || id AS author,
       'noindex' AS robots, 'w' AS viewport, 'xx' AS language, 'og:title=o' || id || ',og:type=t' AS og FROM r
UNION ALL
SELECT id, 'dynamic', 'T & ' || id, ' d' || id || ' ', 'k2', 'a' || id, 'noindex', 'w', 'xx', 'og:site=s' FROM r
""".replace("'T  & '", "'T  &' || chr(9)"))
def q_meta(spark, sf):
    """H1-H4: every metadata field and all Open Graph pairs, both dialects."""
    og = "array_join(transform(array_sort(map_entries(metadata.open_graph)), e -> concat(e.key, '=', e.value)), ',')"
    return _both(spark, sf, lambda raw: raw.select(
        _pid(), *[F.col(f"metadata.{c}").alias(c) for c in ("title", "description", "keywords", "author", "robots", "viewport", "language")],
        F.expr(og).alias("og")))


@query("extract_headings_full", """
SELECT id AS page_id, 'static' AS mode, pos, level, text, '' AS hid, '' AS classes FROM r,
  (VALUES (1::BIGINT, 2::BIGINT, 'Two'), (2, 1, 'One'), (3, 3, 'Three'), (4, 6, 'Six')) v(pos, level, t),
  LATERAL (SELECT CASE t WHEN 'Two' THEN 'Two  ' || id ELSE t END AS text)
UNION ALL
SELECT id, 'dynamic', pos, level, text, CASE t WHEN 'Two' THEN 'i2' ELSE '' END, CASE t WHEN 'Two' THEN 'a,b' ELSE '' END FROM r,
  (VALUES (1::BIGINT, 1::BIGINT, 'One'), (2, 2, 'Two'), (3, 3, 'Three'), (4, 6, 'Six')) v(pos, level, t),
  LATERAL (SELECT CASE t WHEN 'Two' THEN 'Two  ' || id ELSE t END AS text)
""")
def q_headings(spark, sf):
    """Headings of all levels; dynamic: grouped by level, with id and classes."""
    return _both(spark, sf, lambda raw: raw.select(_pid(), F.posexplode("content.headings").alias("p", "h")).select(
        "page_id", (F.col("p") + 1).alias("pos"), "h.level", "h.text", F.coalesce("h.id", F.lit("")).alias("hid"),
        F.coalesce(F.array_join("h.class", ","), F.lit("")).alias("classes")))


@query("extract_paragraphs_full", f"""
SELECT id AS page_id, pos, text FROM r, (VALUES (1::BIGINT, '{_LONG}'), (2, 'p')) v(pos, t),
  LATERAL (SELECT CASE t WHEN 'p' THEN 'Paragraph number ' || id ELSE t END AS text)
""")
def q_paragraphs(spark, sf):
    """H8, P5, F1: paragraphs in order, blank and short ones dropped, cleaned."""
    rec = process_records(extract_raw(rich_pages(spark, sf)), RUN_TS)
    return _long(rec.select("page_id", F.posexplode("content.paragraphs").alias("p", "text"))
                 .select("page_id", (F.col("p") + 1).alias("pos"), "text"))


@query("extract_lists_full", """
SELECT id AS page_id, mode, pos, type, replace(items, '@', id) AS items FROM r,
  (VALUES ('static', 1::BIGINT, 'ol', 'z'), ('static', 2, 'ul', 'x@y|y'), ('static', 3, 'ul', 'y'),
          ('dynamic', 1, 'ul', 'x@y|y'), ('dynamic', 2, 'ul', 'y'), ('dynamic', 3, 'ol', 'z')) v(mode, pos, type, items)
""")
def q_lists(spark, sf):
    """H9: item texts of nested lists; dynamic: all ul before all ol."""
    return _both(spark, sf, lambda raw: raw.select(_pid(), F.posexplode("content.lists").alias("p", "l")).select(
        "page_id", (F.col("p") + 1).alias("pos"), "l.type", F.array_join("l.items", "|").alias("items")))


@query("extract_links_full", """
SELECT id AS page_id, mode, pos, CASE k WHEN 'a' THEN origin || '/a' || id WHEN 'e' THEN 'https://ext.example/' || id
         WHEN 'm' THEN 'mailto:x@y' WHEN 'f' THEN base || '#f' ELSE origin || '/d/q r' END AS url,
       text, title, CASE WHEN mode = 'dynamic' THEN target ELSE '' END AS target, k IN ('e', 'm') AS is_external
FROM r, (VALUES ('static'), ('dynamic')) d(mode),
  (VALUES (1::BIGINT, 'a', 'link one', 'tt', '_blank'), (2, 'e', 'ext', '', ''), (3, 'm', 'm', '', ''), (4, 'f', 'frag', '', ''),
          (5, 'a', 'dup', '', ''), (6, 's', 'space', '', '')) v(pos, k, text, title, target)
""")
def q_links(spark, sf):
    """External, pseudo, fragment, repeated and spaced links, both dialects."""
    return _both(spark, sf, lambda raw: raw.select(_pid(), F.posexplode("links").alias("p", "l")).select(
        "page_id", (F.col("p") + 1).alias("pos"), "l.url", "l.text", "l.title", "l.target", "l.is_external"))


@query("extract_images", """
SELECT id AS page_id, pos, CASE k WHEN 'i' THEN origin || '/i' || id || '.png' WHEN 'c' THEN 'https://cdn.example/x.png' ELSE 'data:zz' END AS src,
       alt, title FROM r, (VALUES (1::BIGINT, 'i', 'al', 'ti'), (2, 'c', '', ''), (3, 'd', '', ''), (4, 'i', 'dup', '')) v(pos, k, alt, title)
""")
def q_images(spark, sf):
    """Every img with a src."""
    raw = extract_raw(rich_pages(spark, sf), tags=frozenset(["img"]))
    return _long(raw.select(_pid(), F.posexplode("images").alias("p", "i"))
                 .select("page_id", (F.col("p") + 1).alias("pos"), "i.src", "i.alt", "i.title"))


@query("extract_form_fields", """
SELECT id AS page_id, mode, form, CASE WHEN form = 1 THEN origin || '/go' || id WHEN mode = 'static' THEN base ELSE '' END AS action,
       CASE WHEN form = 1 THEN 'post' ELSE 'get' END AS method, field, name, CASE WHEN mode = 'static' THEN ts ELSE td END AS type,
       required, placeholder, CASE WHEN mode = 'static' THEN os ELSE od END AS options
FROM r, (VALUES ('static'), ('dynamic')) d(mode),
  (VALUES (1::BIGINT, 1::BIGINT, 'q', 'input', 'text', true, 'ph', NULL, NULL),
          (1, 2, 's', 'select', 'select-one', false, '', ':A:false,b:B:false', 'A:A:true,b:B:false'),
          (1, 3, 't', 'textarea', 'textarea', false, '', NULL, NULL),
          (2, 1, '', 'CHECKBOX', 'checkbox', false, '', NULL, NULL)) v(form, field, name, ts, td, required, placeholder, os, od)
""")
def q_forms(spark, sf):
    """Two forms, all fields and options; dynamic: browser properties."""
    opts = "array_join(transform(x.options, o -> concat_ws(':', o.value, o.text, CAST(o.selected AS STRING))), ',')"
    return _both(spark, sf, lambda raw: raw.select(_pid(), F.posexplode("forms").alias("p", "f"))
                 .select("page_id", (F.col("p") + 1).alias("form"), "f.action", "f.method", F.posexplode("f.fields").alias("q", "x"))
                 .select("page_id", "form", "action", "method", (F.col("q") + 1).alias("field"), "x.name", "x.type", "x.required",
                         "x.placeholder", F.expr(opts).alias("options")))


_LINK_ROWS = """(VALUES (1::BIGINT, 'a', 'link one', 'tt', false), (2, 'e', 'ext', '', true), (3, 'f', 'frag', '', false)) v(n, k, text, title, ext)"""
_LINK_URL = "CASE k WHEN 'a' THEN origin || '/a' || id WHEN 'e' THEN 'https://ext.example/' || id ELSE base || '#f' END"


@query("page_links", f"""
SELECT id AS page_id, base AS url, 'T & ' || id AS title, n AS link_number, {_LINK_URL} AS link_url, text AS link_text,
       title_ AS link_title, ext AS is_external FROM r, (SELECT n, k, text, title AS title_, ext FROM {_LINK_ROWS})
""")
def q_page_links(spark, sf):
    """J4 (+ W1, D1, F6, P3, F18): pages with their link rows, page by page."""
    rec = process_records(extract_raw(rich_pages(spark, sf)), RUN_TS)
    joined = page_children_local(rec, "links")
    return _long(joined.select("page_id", "url", "title", "link_number", "link_url", "link_text", "link_title", "is_external"))


@query("page_images", """
SELECT id AS page_id, base AS url, id || '_img_' || n AS image_id, CASE n WHEN 1 THEN origin || '/i' || id || '.png' ELSE 'https://cdn.example/x.png' END AS image_src,
       CASE n WHEN 1 THEN 'al' ELSE '' END AS image_alt, n = 2 AS is_external, 2::BIGINT AS image_count
FROM r, (VALUES (1), (2)) v(n)
""")
def q_page_images(spark, sf):
    """The written tables, bucketed by page, joined in place."""
    import uuid

    rec = staged(process_records(extract_raw(rich_pages(spark, sf)), RUN_TS), "page-records")       # parsed once for both tables
    name = f"j4_{uuid.uuid4().hex[:12]}"
    tables = write_bucketed({"pages": pages_table(rec), "images": images_table(rec)}, name, checkpoint_path(spark, name), 16)
    joined = page_children(tables["pages"], tables["images"])
    return _long(joined.select("page_id", "url", "image_id", "image_src", "image_alt", "is_external", "image_count"))


@query("framework_counts", """
SELECT 'angular' AS framework, count(*) AS pages FROM r UNION ALL SELECT 'react', count(*) FROM r WHERE page_id % 2 = 0
""")
def q_frameworks(spark, sf):
    """A6 (+ H15): pages per framework marker."""
    return framework_counts(extract_raw(rich_pages(spark, sf), "dynamic"))


@query("run_summary", """
SELECT replace(origin, 'https://', '') AS host, count(*) AS pages_scraped, 3 * count(*) AS links_found, 2 * count(*) AS images_found,
       4 * count(*) AS headings_found, 2 * count(*) AS paragraphs_found, 2 * count(*) AS forms_found,
       CAST(sum(WORDS) AS BIGINT) AS word_count, CAST(sum(CHARS) AS BIGINT) AS character_count
FROM (SELECT *, 'Two ' || id || 'One Three Six shortFILLER ' || 'Paragraph number ' || id || 'zx' || id || 'y link one extmfragdupspacenone' AS t FROM r)
GROUP BY origin
""".replace("FILLER", FILLER.strip()).replace("WORDS", "len(string_split(t, ' '))").replace("CHARS", "length(t)"))
def q_run_summary(spark, sf):
    """A3: the eight run counters summed by host."""
    return run_summary(process_records(extract_raw(rich_pages(spark, sf)), RUN_TS))


@query("captcha_by_selector", """
SELECT id AS page_id,
       CASE page_id % 5 WHEN 0 THEN '.g-recaptcha' WHEN 1 THEN 'iframe[src*="hcaptcha"]' WHEN 2 THEN '[id*="captcha"]' END AS gate,
       CASE page_id % 5 WHEN 0 THEN '.g-recaptcha' WHEN 1 THEN 'iframe[src*="captcha"]' WHEN 2 THEN '[id*="captcha"]' END AS rendered
FROM r
""")
def q_selectors(spark, sf):
    """P10: first matching captcha selector, for the gate and the rendered list."""
    dom = parse_dom(rich_pages(spark, sf))
    return dom.select(_pid(), F.expr(G.captcha_by_selector_sql("dom")).alias("gate"),
                      F.expr(G.captcha_by_selector_sql("dom", G.RENDERED_CAPTCHA_SELECTORS)).alias("rendered"))


@query("configured_selectors", """
SELECT id AS page_id, 'Two  ' || id AS titles, 'link one,ext,m,frag,dup,space' AS links, '' AS missing FROM r
""")
def q_configured(spark, sf):
    """Texts by configured selector lists; the first selector that matches counts."""
    dom = parse_dom(rich_pages(spark, sf))
    pick = lambda sels: F.array_join(F.expr(select_texts_sql("dom", sels)), ",")
    return dom.select(_pid(), pick([".headline", "#i2", "h1"]).alias("titles"), pick(["a[href]"]).alias("links"),
                      pick([".nope", 'div[role="none"]']).alias("missing"))


@query("route_errors", """
SELECT id AS page_id, '' AS url, 'error' AS status, 'Missing URL' AS error, 0::BIGINT AS links_found FROM r WHERE page_id % 10 = 3
""")
def q_route_errors(spark, sf):
    """Records without a url leave the flow as error rows with zero counts."""
    pages = rich_pages(spark, sf).withColumn("url", F.when(F.col("page_id") % 10 == 3, "").otherwise(F.col("url")))
    return _long(errors_table(process_records(extract_raw(pages), RUN_TS)).select("page_id", "url", "status", "error", "links_found"))


#: Layouts of the main part, by page id; ``#`` stands for the long line.
LAYOUTS = ["<section>#</section>", '<div class="content">#</div>', '<div id="content">#</div>', '<div class="x main-content">#</div>',
           '<div class="post-content">#</div>', '<section role="main">#</section>', "<main>short</main><article>#</article>",
           "<main>short</main><p>#</p>"]


@query("main_content_layouts", f"""
SELECT id AS page_id, mode, sel AS main_selector,
       CASE WHEN sel <> 'body' THEN '{_LONG}' WHEN page_id % 8 = 7 THEN 'topshort{_LONG}' ELSE 'top{_LONG}' END AS text,
       mode = 'dynamic' AND page_id % 3 = 0 AS has_vue
FROM r, (VALUES ('static'), ('dynamic')) m(mode),
LATERAL (SELECT CASE page_id % 8 WHEN 0 THEN CASE mode WHEN 'static' THEN 'section' ELSE 'body' END WHEN 1 THEN '.content' WHEN 2 THEN '#content'
         WHEN 3 THEN '.main-content' WHEN 4 THEN CASE mode WHEN 'static' THEN '.post-content' ELSE 'body' END
         WHEN 5 THEN CASE mode WHEN 'static' THEN 'section' ELSE 'section[role=main]' END WHEN 6 THEN 'article' ELSE 'body' END AS sel)
""")
def q_layouts(spark, sf):
    """H5 (+ H6, H15): every content selector in both dialects, and the Vue marker."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    part = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{x.replace('#content', '@').replace('#', FILLER).replace('@', '#content')}'"
                                          for i, x in enumerate(LAYOUTS)) + " END"
    vue = "CASE WHEN page_id % 3 = 0 THEN '<b data-v-=\"\"></b>' ELSE '' END"
    html = F.expr(f"concat('<html><body><i>top</i>', {vue}, {part}, '</body></html>')")
    parsed = staged(parse_dom(spread_by_bytes(pages.select("page_id", "url", html.alias("html")), TASK_BYTES)), "dom")
    rows = [dom_to_raw(parsed, mode, fields=("content", "frameworks")).select(
        _pid(), F.lit(mode).alias("mode"), "main_selector", F.col("content.text").alias("text"),
        F.expr("coalesce(frameworks['vue'], false)").alias("has_vue")) for mode in ("static", "dynamic")]
    return rows[0].unionByName(rows[1])


@query("host_rollup_full", """
SELECT replace(origin, 'https://', '') AS host, count(*) AS pages, CAST(3 * count(*) AS BIGINT) AS links, count(*) AS external_links,
       avg(CASE WHEN page_id % 4 <> 3 THEN page_id % 90 END) AS avg_response_ms
FROM r GROUP BY ROLLUP (replace(origin, 'https://', ''))
""")
def q_host_rollup_full(spark, sf):
    """A4: external links and response times per host (NULL times are left out
    of the mean) and in total."""
    pages = rich_pages(spark, sf).withColumn("response_time_ms", F.when(F.col("page_id") % 4 != 3, (F.col("page_id") % 90).cast("int")))
    return _long(host_rollup(process_records(extract_raw(pages, fields=("links",)), RUN_TS)))


@query("pages_table_filled", """
SELECT id AS page_id, filled, CASE page_id % 3 WHEN 1 THEN 404::BIGINT WHEN 2 THEN 301 ELSE CASE WHEN filled THEN 200 END END AS http_status_code,
       CASE WHEN page_id % 2 = 0 THEN 7::BIGINT WHEN filled THEN 0 END AS response_time_ms, 2::BIGINT AS form_count, 2::BIGINT AS image_count
FROM r, (VALUES (true), (false)) v(filled)
""")
def q_pages_table_filled(spark, sf):
    """F8, A1: NULL fetch fields stay NULL, or take the defaults when asked to."""
    pages = rich_pages(spark, sf).selectExpr("*", "CASE page_id % 3 WHEN 1 THEN 404 WHEN 2 THEN 301 END AS http_status_code",
                                             "CASE WHEN page_id % 2 = 0 THEN 7 END AS response_time_ms")
    facts = staged(page_facts(dom_to_facts(parse_dom(pages)), RUN_TS), "filled")
    rows = [pages_table(facts, fill_http_defaults=f).select("page_id", F.lit(f).alias("filled"), "http_status_code", "response_time_ms",
                                                            "form_count", "image_count") for f in (True, False)]
    return _long(rows[0].unionByName(rows[1]))
