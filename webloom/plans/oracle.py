"""SQL building blocks for the DuckDB oracle queries.

The oracle side re-derives every registered result from the raw driver
tables with plain SQL (regular expressions over the stored HTML, window
functions, joins), independently of the Spark implementation.  These
helpers only spell out shared expressions once.
"""

from __future__ import annotations

from ..functions.text import PY_WS_CODEPOINTS


def _re2_class(cps) -> str:
    return "[" + "".join("\\x{%x}" % c for c in cps) + "]"


WS = _re2_class(PY_WS_CODEPOINTS)          # Python str.isspace() set
CTRL = "[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}]"

# Fixed values, written out here so that the SQL does not take them from the
# code it checks: keyword lists, markup markers and messages of the gates.
GATE_WORDS = ['captcha', 'recaptcha', 'hcaptcha', 'verify', 'verification', 'prove', 'robot', 'human']
STATIC_WORDS = ['captcha', 'recaptcha', 'verify', 'robot', 'human', 'prove']
MARKERS = ['react', 'vue', 'angular', 'ember', 'backbone', 'webpack', 'parcel', 'rollup', 'vite',
           'data-react', 'ng-app', 'v-app', '#app', '.app', 'router-view', 'component', 'directive']
MSG_ROBOTS = 'Robots.txt disallows scraping'
MSG_CAPTCHA = 'CAPTCHA detected - scraping blocked'
MSG_NO_DATA = 'Scraping failed - no data retrieved'

# The HTML entities that occur in the driver's pages.
ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
            ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return out


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '{CTRL}', '', 'g'))"


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> ''))"


# The pages with their main content, following the extraction rules:
# <article> when its stripped text is longer than 200 characters, else <body>
# (comments excluded).  Paragraph rule: an unclosed <p><b>… paragraph runs
# to the end of the article, a closed <p> to its </p>.
PAGES_MAIN = f"""
p0 AS (
  SELECT page_id, url, html,
         regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art,
         regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)</body>.*$', '') AS bod
  FROM pages),
p1 AS (
  SELECT *, {decode(no_tags('art'))} AS art_text,
            {decode(no_tags("regexp_replace(bod, '(?s)<!--.*?-->', '', 'g')"))} AS body_text,
            string_split(art, '<p>') AS segs
  FROM p0),
pm AS (
  SELECT *,
         CASE WHEN length({strip('art_text')}) > 200 THEN 'article' ELSE 'body' END AS main_selector,
         CASE WHEN length({strip('art_text')}) > 200 THEN art_text ELSE body_text END AS main_raw,
         {strip(decode(no_tags("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")))} AS title_raw,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         {strip(decode(no_tags("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)")))} AS h1_raw,
         list_filter(list_transform(generate_series(2, len(segs)), lambda i:
             {strip(decode(no_tags("CASE WHEN starts_with(segs[i], '<b>') THEN array_to_string(segs[i:], '<p>') ELSE split_part(segs[i], '</p>', 1) END")))}),
           lambda t: length(t) > 10) AS paras_raw
  FROM p1),
pc AS (
  SELECT *, {clean('main_raw')} AS text, {clean('title_raw')} AS title, {clean('h1_raw')} AS h1,
         list_transform(paras_raw, lambda t: {clean('t')}) AS paras
  FROM pm)
"""

# Anchor list of each page: (page_id, pos, href, text), document order.
ANCHORS = """
anc AS (
  SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1) AS scheme,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS netloc,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts
  FROM pages),
anc_i AS (SELECT *, unnest(generate_series(1, len(hrefs))) AS i FROM anc),
anc_rows AS (
  SELECT page_id, url, netloc, i AS pos, hrefs[i] AS href, texts[i] AS atext,
         lower(scheme) || '://' || netloc || hrefs[i] AS abs_url
  FROM anc_i)
"""


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def origin(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)})"


def base_dir(u: str) -> str:
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    return f"regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '[^/]*$', '')"


def resolve_simple(src: str, base: str) -> str:
    """urljoin for the fixture's href shapes: absolute, pseudo, root-relative
    and plain relative (no dot segments)."""
    return (f"CASE WHEN {src} LIKE 'http://%' OR {src} LIKE 'https://%' OR {src} LIKE 'data:%' THEN {src} "
            f"WHEN {src} LIKE '/%' THEN {origin(base)} || {src} "
            f"ELSE {origin(base)} || {base_dir(base)} || {src} END")


PART_IMAGES = """
pimg AS (
  SELECT p.p_partkey % (SELECT max(page_id) + 1 FROM pages) AS page_id, p.p_partkey AS pos, pg.url AS base_url, p.p_name AS alt,
         CASE p.p_partkey % 4 WHEN 0 THEN '/img/' || CAST(p.p_partkey % 7 AS VARCHAR) || '.png'
              WHEN 1 THEN 'https://cdn.example.com/' || CAST(p.p_partkey % 5 AS VARCHAR)
              WHEN 2 THEN 'data:x' ELSE ' a b.png' END AS src
  FROM part p JOIN pages pg ON pg.page_id = p.p_partkey % (SELECT max(page_id) + 1 FROM pages))
"""

PART_LINKS = """
plink AS (
  SELECT p.p_partkey % (SELECT max(page_id) + 1 FROM pages) AS page_id, p.p_partkey AS pos, pg.url AS base_url, p.p_name AS text,
         CASE p.p_partkey % 6 WHEN 0 THEN '/p/' || CAST(p.p_size AS VARCHAR)
              WHEN 1 THEN 'mailto:x' || CAST(p.p_partkey AS VARCHAR) || '@example.com' WHEN 2 THEN '#frag'
              WHEN 3 THEN 'https://other.example/' || p.p_brand
              WHEN 4 THEN '  /p/' || CAST(p.p_size AS VARCHAR)
              ELSE 'HTTP://UPPER.example/x' || CAST(p.p_size AS VARCHAR) END AS url
  FROM part p JOIN pages pg ON pg.page_id = p.p_partkey % (SELECT max(page_id) + 1 FROM pages))
"""

REQUEST_URLS = """
SELECT url, CASE WHEN url LIKE '%/en/%' THEN 'static' WHEN url LIKE '%/fr/%' THEN 'dynamic'
                 WHEN url LIKE '%/de/%' THEN 'bogus' ELSE 'auto' END AS scraping_type
FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES
  ('http://localhost/x'), ('http://10.1.2.3/a'), ('https://h.example.com/v10.2'), ('https://h.example.com:80/p'),
  ('ftp://h.example/f'), ('http://user:pw@h.example.com/'), ('http://192.168.0.1/'), ('javascript:alert(1)'), (''),
  ('   https://ok.example/  '), ('https://[::1]/'), ('http://172.20.1.1/'), ('http://169.254.0.1/')) t(url))
"""

_HOSTINFO = f"regexp_extract({netloc('ltrim(url)')}, '([^@]*)$', 1)"
_HOST = (f"lower(CASE WHEN {_HOSTINFO} LIKE '[%' THEN regexp_extract({_HOSTINFO}, '\\[([^\\]]*)', 1) "
         f"ELSE regexp_extract({_HOSTINFO}, '^([^:]*)', 1) END)")
REQUEST_FACTS = f"""
  ({scheme('trim(url)')} IN ('http', 'https') AND regexp_full_match({netloc('trim(url)')}, '[a-zA-Z0-9.\\-]+')) AS scrapable,
  regexp_matches(url, '(?i)(localhost|127\\.0\\.0\\.1|192\\.168\\.|10\\.|172\\.1[6-9]\\.|172\\.2[0-9]\\.|172\\.3[0-1]\\.|file://|ftp://|javascript:|data:|mailto:|tel:)') AS suspicious,
  ({_HOST} = '' OR regexp_matches({_HOST}, '^(localhost$|127\\.0\\.0\\.1$|192\\.168\\.|10\\.|172\\.1[6-9]\\.|172\\.2[0-9]\\.|172\\.3[0-1]\\.|169\\.254\\.|::1$|fc00:|fe80:)')) AS private
"""

# Whole-document text (get_text of the page: no script/style/comments) and
# the summed length of its stripped text nodes.
DOC_TEXT = f"""
dt0 AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
dt AS (SELECT page_id, {decode(no_tags('h'))} AS doc_text,
              list_sum(list_transform(regexp_extract_all(h, '>([^<]*)<', 1), lambda t: length({strip(decode('t'))}))) AS strip_len
       FROM dt0)
"""

FETCHED = """
fp AS (SELECT page_id, url, html,
         CASE WHEN url LIKE '%spam%' THEN 403 WHEN url LIKE '%?page=2%' THEN 429 WHEN url LIKE '%.html' THEN 503
              WHEN url LIKE '%#top' THEN 404 ELSE 200 END AS status,
         CASE WHEN url LIKE 'https://m.%' THEN 'cloudflare' ELSE 'nginx' END AS server
       FROM pages)
"""


def first_keyword(text: str, words) -> str:
    whens = " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words)
    return f"CASE {whens} END"


def markers(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def status_badge(s: str) -> str:
    return (f"CASE {s} WHEN 'completed' THEN 'success' WHEN 'error' THEN 'danger' "
            f"WHEN 'running' THEN 'warning' ELSE 'info' END")
