"""H1-H16 — page extractors as Spark SQL expressions over the flat DOM.

Each extractor is a Spark SQL expression built from higher-order functions
(``filter``/``transform``/``slice``) over ``dom.nodes`` of the same row, so
extraction is page-local: no shuffle, no Python.  ``extract_raw`` assembles
them into the RAW record of SURVEY §1.2.

Two dialects: ``mode='static'`` (the HTML-parser scraper) and
``mode='dynamic'`` (the rendered-page scraper).  In dynamic mode the
browser's ``innerText`` is approximated by the DOM text (no layout engine
here); the other differences — main-content selectors, heading grouping by
level with id/class, list order, meta rules, form action — follow the
rendered-page scraper.

The ``*_sql`` builders take SQL text for the DOM struct (``d``) and a node
(``n``) and return SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import expr, fresh, lam, let, q, qlist, struct
from ..functions.text import clean_text_sql, has_token_sql, html_unescape, py_strip_sql, split_classes_sql
from ..functions.urls import url_join_facts_sql, url_join_parts_sql, url_split_sql
from .dom import parse_dom

HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
META_FIELDS = ["description", "keywords", "author", "robots", "viewport"]
# Main-content candidates, in priority order, per dialect.
STATIC_MAIN_SELECTORS = ["main", "article", "section", ".content", "#content", ".main-content", ".post-content"]
DYNAMIC_MAIN_SELECTORS = ["main", "article", "section[role=main]", ".content", "#content", ".main-content"]
MAIN_MIN_CHARS = 200
PARAGRAPH_MIN_CHARS = 10
# DOM markers of client frameworks (attribute present).
FRAMEWORK_MARKERS = [("react", "data-reactroot"), ("vue", "data-v-"), ("angular", "ng-app")]

RAW_STATIC_FIELDS = 12   # keys of the static scraper's record
RAW_DYNAMIC_FIELDS = 13  # + javascript_info


def attr(n: str, name: str) -> str:
    return f"{n}.attrs[{q(name)}]"


def attr_or_empty(n: str, name: str) -> str:
    return f"coalesce({attr(n, name)}, '')"


def has_attr(n: str, name: str) -> str:
    return f"map_contains_key({n}.attrs, {q(name)})"


def is_tag(n: str, tag: str) -> str:
    return f"{n}.tag = {q(tag)}"


def with_bytes(d: str, body) -> str:
    """``body`` with the page text as bytes, bound once: a span of bytes is
    cut out in the time of its length, whereas a character offset of a string
    is found by walking there."""
    return let(f"CAST({d}.text AS BINARY)", body)


def span(b: str, n: str) -> str:
    """``element.get_text()``: the element's span of the page's bytes."""
    return f"CAST(substring({b}, {n}.t0 + 1, {n}.t1 - {n}.t0) AS STRING)"


def node_text(d: str, n: str) -> str:
    """Text of one element (``span`` where many are cut out of a page)."""
    return span(f"CAST({d}.text AS BINARY)", n)


def subtree(d: str, n: str) -> str:
    """Descendants of ``n`` (``find_all`` scope), in document order."""
    return f"slice({d}.nodes, {n}.i + 2, {n}.last - {n}.i)"


def where(arr: str, pred) -> str:
    return f"filter({arr}, {lam(pred)})"


def first(arr: str, pred) -> str:
    return f"try_element_at({where(arr, pred)}, 1)"


def selector_pred(sel: str):
    """Predicate for one selector: any of ``tag``, ``.cls``, ``#id``, ``[attr]``,
    ``[attr="v"]``, ``[attr*="v"]``, the last three also after a tag."""
    if sel.startswith("."):
        return lambda n: has_token_sql(attr(n, "class"), sel[1:])
    if sel.startswith("#"):
        return lambda n: f"coalesce({attr(n, 'id')} = {q(sel[1:])}, false)"
    tag, _, rest = sel.partition("[")
    if not rest:
        return lambda n: is_tag(n, tag)
    key, eq, val = rest.rstrip("]").partition("=")
    val = val.strip("\"'")

    def cond(n):
        if not eq:
            return has_attr(n, key)
        if key.endswith("*"):
            return f"coalesce(contains({attr(n, key[:-1])}, {q(val)}), false)"
        return f"coalesce({attr(n, key)} = {q(val)}, false)"
    return (lambda n: f"({is_tag(n, tag)} AND {cond(n)})") if tag else cond


def select_texts_sql(d: str, selectors: list[str]) -> str:
    """Stripped texts of the elements that match the first of the given
    selectors that matches any (configured selector lists)."""
    def texts(b):
        cases = " ".join(f"WHEN exists({d}.nodes, {lam(selector_pred(s))}) THEN "
                         f"transform({where(f'{d}.nodes', selector_pred(s))}, {lam(lambda n: py_strip_sql(span(b, n)))})"
                         for s in selectors)
        return f"CASE {cases} ELSE CAST(array() AS array<string>) END"
    return with_bytes(d, texts)


# --------------------------------------------------------------------------
# H1-H4, H16 metadata

def title_sql(d: str, mode: str = "static") -> str:
    """H1: stripped text of the first <title>, else ''.  (dynamic:
    document.title also collapses inner whitespace)."""
    def body(t):
        txt = node_text(d, t)
        if mode == "dynamic":
            txt = f"regexp_replace({txt}, {q('[\\t\\n\\f\\r ]+')}, ' ')"
        return py_strip_sql(txt)
    title = first(f"{d}.nodes", lambda n: is_tag(n, "title"))
    return f"coalesce({let(title, body)}, '')"


def meta_sql(d: str, name: str, mode: str = "static") -> str:
    """H2: static — first <meta name=X>: stripped content ('' if it has no
    content); NULL when there is no such tag.  dynamic — last meta whose
    name (or http-equiv) is X with non-empty content, unstripped."""
    if mode == "static":
        m = first(f"{d}.nodes", lambda n: f"({is_tag(n, 'meta')} AND coalesce({attr(n, 'name')} = {q(name)}, false))")
        return let(m, lambda x: f"CASE WHEN {x} IS NOT NULL THEN {py_strip_sql(attr_or_empty(x, 'content'))} END")

    def hit(n):
        label = f"coalesce(nullif({attr(n, 'name')}, ''), {attr(n, 'http-equiv')})"
        return f"({is_tag(n, 'meta')} AND {label} = {q(name)} AND {attr_or_empty(n, 'content')} != '')"
    return f"try_element_at(transform({where(f'{d}.nodes', hit)}, {lam(lambda n: attr(n, 'content'))}), -1)"


def open_graph_sql(d: str, mode: str = "static") -> str:
    """H3: map of og: properties to content, last one wins.  The dynamic
    scraper can only see og: keys given as ``name``/``http-equiv``."""
    if mode == "static":
        def key(n):
            return attr(n, "property")

        def val(n):
            return attr_or_empty(n, "content")

        def cond(n):
            return f"({is_tag(n, 'meta')} AND coalesce(startswith({key(n)}, 'og:'), false))"
    else:
        def key(n):
            return f"coalesce(nullif({attr(n, 'name')}, ''), {attr(n, 'http-equiv')})"

        def val(n):
            return attr(n, "content")

        def cond(n):
            return (f"({is_tag(n, 'meta')} AND coalesce(startswith({key(n)}, 'og:'), false) "
                    f"AND {attr_or_empty(n, 'content')} != '')")
    entries = f"transform({where(f'{d}.nodes', cond)}, {lam(lambda n: struct(('k', key(n)), ('v', val(n))))})"

    def last_wins(es):
        e, i, x = fresh(), fresh(), fresh()
        later = f"slice({es}, {i} + 2, greatest(size({es}) - {i} - 1, 0))"
        return f"map_from_entries(filter({es}, ({e}, {i}) -> NOT exists({later}, {x} -> {x}.k = {e}.k)))"
    return let(entries, last_wins)


def language_sql(d: str) -> str:
    """H4: <html lang> or ''."""
    h = first(f"{d}.nodes", lambda n: is_tag(n, "html"))
    return f"coalesce({let(h, lambda x: attr(x, 'lang'))}, '')"


# --------------------------------------------------------------------------
# H5-H9 main content

def main_content_sql(d: str, mode: str = "static") -> str:
    """H5: struct<node, selector> of the main-content element, or NULL when
    the page has no body.  Only the first element per selector is tested;
    it wins when its text is longer than 200 characters (stripped in static
    mode), else <body>."""
    sels = STATIC_MAIN_SELECTORS if mode == "static" else DYNAMIC_MAIN_SELECTORS

    def heavy(n):
        t = node_text(d, n)
        return f"length({py_strip_sql(t) if mode == 'static' else t}) > {MAIN_MIN_CHARS}"

    def candidate(s):
        def pick(n):
            return f"CASE WHEN {n} IS NOT NULL AND {heavy(n)} THEN {struct(('node', n), ('selector', q(s)))} END"
        return let(first(f"{d}.nodes", selector_pred(s)), pick)
    body = let(first(f"{d}.nodes", lambda n: is_tag(n, "body")),
               lambda n: f"CASE WHEN {n} IS NOT NULL THEN {struct(('node', n), ('selector', q('body')))} END")
    return "coalesce(" + ", ".join([candidate(s) for s in sels] + [body]) + ")"


def headings_sql(d: str, m: str, mode: str = "static") -> str:
    """H7: h1-h6 under the main element.  static: document order, stripped
    text.  dynamic: grouped by level, with id and class list."""
    hs = where(subtree(d, m), lambda n: f"{n}.tag IN ({qlist(HEADING_TAGS)})")
    if mode == "dynamic":
        a, b = fresh(), fresh()
        hs = (f"array_sort({hs}, ({a}, {b}) -> CASE WHEN {a}.tag < {b}.tag THEN -1 WHEN {a}.tag > {b}.tag THEN 1 "
              f"WHEN {a}.i < {b}.i THEN -1 WHEN {a}.i > {b}.i THEN 1 ELSE 0 END)")

    def one(b, n):
        return struct(("level", f"CAST(substring({n}.tag, 2, 1) AS INT)"),
                      ("text", py_strip_sql(span(b, n))),
                      ("id", attr_or_empty(n, "id") if mode == "dynamic" else "CAST(NULL AS STRING)"),
                      ("class", split_classes_sql(attr(n, "class")) if mode == "dynamic" else "CAST(NULL AS array<string>)"))
    return with_bytes(d, lambda b: f"transform({hs}, {lam(lambda n: one(b, n))})")


def paragraphs_sql(d: str, m: str) -> str:
    """H8: stripped <p> texts longer than 10 characters."""
    ps = where(subtree(d, m), lambda n: is_tag(n, "p"))
    texts = with_bytes(d, lambda b: f"transform({ps}, {lam(lambda n: py_strip_sql(span(b, n)))})")
    return where(texts, lambda t: f"({t} != '' AND length({t}) > {PARAGRAPH_MIN_CHARS})")


def lists_sql(d: str, m: str, mode: str = "static") -> str:
    """H9: each ul/ol with the stripped text of every li inside it (nested
    items count in every ancestor list).  dynamic: all ul, then all ol."""
    ls = where(subtree(d, m), lambda n: f"{n}.tag IN ('ul', 'ol')")
    if mode == "dynamic":
        ls = let(ls, lambda x: f"concat({where(x, lambda n: is_tag(n, 'ul'))}, {where(x, lambda n: is_tag(n, 'ol'))})")

    def one(b, l):
        lis = where(subtree(d, l), lambda n: is_tag(n, "li"))
        items = f"transform({lis}, {lam(lambda n: py_strip_sql(span(b, n)))})"
        return struct(("type", f"{l}.tag"), ("items", items))
    return with_bytes(d, lambda b: f"transform({ls}, {lam(lambda l: one(b, l))})")


# --------------------------------------------------------------------------
# H10-H15 links, images, forms, frameworks

def _url_ok(u: str) -> str:
    return f"{url_split_sql(u)}.ok"


def links_sql(d: str, url: str, b: str, mode: str = "static") -> str:
    """Every a[href] in the whole page: absolute url, stripped text,
    title, is_external (dynamic also target), and whether the href parses."""
    anchors = where(f"{d}.nodes", lambda n: f"({is_tag(n, 'a')} AND {has_attr(n, 'href')})")

    def one(text, n):
        href = attr(n, "href")
        target = attr_or_empty(n, "target") if mode == "dynamic" else "''"
        return let(url_join_facts_sql(url, b, href), lambda u: struct(
            ("url", f"{u}.url"), ("text", py_strip_sql(span(text, n))),
            ("title", attr_or_empty(n, "title")), ("target", target),
            ("is_external", f"{u}.is_external"), ("ok", f"{u}.ok")))
    return with_bytes(d, lambda text: f"transform({anchors}, {lam(lambda n: one(text, n))})")


def images_sql(d: str, url: str, b: str) -> str:
    """Every img[src]: absolute src, alt, title."""
    imgs = where(f"{d}.nodes", lambda n: f"({is_tag(n, 'img')} AND {has_attr(n, 'src')})")

    def one(n):
        return let(url_join_facts_sql(url, b, attr(n, "src")), lambda u: struct(
            ("src", f"{u}.url"), ("alt", attr_or_empty(n, "alt")), ("title", attr_or_empty(n, "title")), ("ok", f"{u}.ok")))
    return f"transform({imgs}, {lam(one)})"


def forms_sql(d: str, url: str, b: str, mode: str = "static") -> str:
    """Forms with absolute action (static: missing → page url;
    dynamic: missing stays ''), lower-cased method (default get), and their
    input/select/textarea fields with select options."""
    def option(b, o):
        text = py_strip_sql(span(b, o))
        if mode == "dynamic":                       # the browser's properties, not the attributes
            return struct(("value", f"coalesce({attr(o, 'value')}, {text})"), ("text", text),
                          ("selected", has_attr(o, "selected")))
        return struct(("value", attr_or_empty(o, "value")), ("text", text), ("selected", has_attr(o, "selected")))

    def chosen(opts, f):
        """A single select without a selected option selects its first."""
        if mode != "dynamic":
            return opts
        o, i = fresh(), fresh()
        first_one = (f"transform({{0}}, ({o}, {i}) -> named_struct('value', {o}.value, 'text', {o}.text, "
                     f"'selected', {i} = 0))")
        return let(opts, lambda x: f"CASE WHEN {has_attr(f, 'multiple')} OR exists({x}, y -> y.selected) THEN {x} "
                                   f"ELSE {first_one.format(x)} END")

    def kind(f):
        if mode != "dynamic":
            return f"coalesce({attr(f, 'type')}, {f}.tag)"
        return (f"CASE {f}.tag WHEN 'input' THEN lower(coalesce(nullif({attr(f, 'type')}, ''), 'text')) "
                f"WHEN 'select' THEN CASE WHEN {has_attr(f, 'multiple')} THEN 'select-multiple' ELSE 'select-one' END "
                f"ELSE {f}.tag END")

    def field(text, f):
        options = where(subtree(d, f), lambda n: is_tag(n, "option"))
        found = f"transform({options}, {lam(lambda o: option(text, o))})"
        opts = f"CASE WHEN {is_tag(f, 'select')} THEN {chosen(found, f)} END"
        return struct(("name", attr_or_empty(f, "name")), ("type", kind(f)),
                      ("id", attr_or_empty(f, "id")), ("class_name", attr_or_empty(f, "class")),
                      ("placeholder", attr_or_empty(f, "placeholder")),
                      ("required", has_attr(f, "required")), ("options", opts))

    def form(text, n):
        action_attr = attr_or_empty(n, "action")
        action = url_join_parts_sql(url, b, action_attr)
        if mode == "dynamic":
            action = f"CASE WHEN {action_attr} = '' THEN '' ELSE {action} END"
        controls = where(subtree(d, n), lambda x: f"{x}.tag IN ({qlist(['input', 'select', 'textarea'])})")
        return struct(("action", action), ("method", f"lower(coalesce({attr(n, 'method')}, 'get'))"),
                      ("id", attr_or_empty(n, "id")), ("class_name", attr_or_empty(n, "class")),
                      ("fields", f"transform({controls}, {lam(lambda f: field(text, f))})"), ("ok", _url_ok(action_attr)))
    forms = where(f"{d}.nodes", lambda n: is_tag(n, "form"))
    return with_bytes(d, lambda text: f"transform({forms}, {lam(lambda n: form(text, n))})")


def frameworks_sql(d: str) -> str:
    """Map of framework → true for each DOM marker found."""
    def entry(k, a):
        return f"CASE WHEN exists({d}.nodes, {lam(lambda n: has_attr(n, a))}) THEN {struct(('k', q(k)), ('v', 'true'))} END"
    e = fresh()
    entries = ", ".join(entry(k, a) for k, a in FRAMEWORK_MARKERS)
    return f"map_from_entries(filter(array({entries}), {e} -> {e} IS NOT NULL))"


def text_strip_length_sql(d: str) -> str:
    """``len(soup.get_text(strip=True))``: sum of stripped text-node lengths."""
    return f"{d}.strip_length"


# --------------------------------------------------------------------------
# H0 assembly

def _by_route(make) -> str:
    """The expression of the page's dialect; only that branch is evaluated."""
    static, dynamic = make("static"), make("dynamic")
    return static if static == dynamic else f"CASE WHEN route = 'dynamic' THEN {dynamic} ELSE {static} END"


#: What ``dom_to_raw`` can be asked for.
RAW_FIELDS = ("metadata", "content", "links", "images", "forms", "frameworks")


def dom_to_raw(parsed: DataFrame, mode: str = "static", url_col: str = "url", fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """Assemble the RAW record columns from a DataFrame with ``dom``.

    ``mode='routed'`` picks the dialect per page: the column
    ``scraping_type`` names it, or (auto) the page's own rendering decides
    (P15, P16); the columns ``rendering`` and ``route`` say how.

    Keeps all incoming columns except ``dom``; adds the ``fields`` asked for
    (all: ``metadata``, ``content`` with ``main_selector``, ``links``,
    ``images``, ``forms``, ``frameworks``), ``text_strip_length`` and
    ``extract_error`` (of the page and the fields asked for).  What is not asked
    for is not built: its expressions would be planned with every query."""
    routed = mode == "routed"
    if routed:
        from .gates import classify_rendering_sql, route_by_type_sql
        parsed = parsed.withColumn("text_strip_length", expr(text_strip_length_sql("dom")))
        parsed = parsed.withColumn("rendering", expr(classify_rendering_sql("_markup_dynamic", "http_status_code",
                                                                            "text_strip_length")))
        parsed = parsed.withColumn("route", expr(route_by_type_sql("scraping_type", "rendering")))
    keep = [c for c in parsed.columns if c not in ("dom", "text_strip_length")]
    url = f"coalesce(`{url_col}`, '')"

    def pick(make) -> str:
        return _by_route(make) if routed else make(mode)

    main = [expr(pick(lambda k: main_content_sql("dom", k))).alias("_main")] if "content" in fields else []
    staged = parsed.select("*", expr(url_split_sql(url)).alias("_base"), *main)

    def metadata(k):
        md = [("title", title_sql("dom", k))]
        md += [(f, meta_sql("dom", f, k)) for f in META_FIELDS]
        md += [("language", language_sql("dom"))]
        if k == "dynamic":
            md += [("url", url), ("domain", "_base.netloc")]
        else:
            md += [("url", "CAST(NULL AS STRING)"), ("domain", "CAST(NULL AS STRING)")]
        return struct(*md, ("open_graph", open_graph_sql("dom", k)))

    m = "_main.node"
    none = "CAST(map() AS map<string,boolean>)"

    def structure(k):
        return struct(("headings", headings_sql("dom", m, k)), ("paragraphs", paragraphs_sql("dom", m)),
                      ("lists", lists_sql("dom", m, k)))

    def listed(name: str, sql: str) -> list:
        return [expr(sql).alias(f"_{name}")] if name in fields else []

    extracted = staged.select(
        *keep,
        *([expr(pick(metadata)).alias("metadata")] if "metadata" in fields else []),
        *([expr(f"CASE WHEN {m} IS NOT NULL THEN {node_text('dom', m)} END").alias("_main_text"),
           expr(f"CASE WHEN {m} IS NOT NULL THEN {pick(structure)} END").alias("_content"),
           F.col("_main.selector").alias("main_selector")] if main else []),
        *listed("links", pick(lambda k: links_sql("dom", url, "_base", k))),
        *listed("images", images_sql("dom", url, "_base")),
        *listed("forms", pick(lambda k: forms_sql("dom", url, "_base", k))),
        *([expr(pick(lambda k: frameworks_sql("dom") if k == "dynamic" else none)).alias("frameworks")]
          if "frameworks" in fields else []),
        (F.col("text_strip_length") if routed else expr(text_strip_length_sql("dom"))).alias("text_strip_length"),
        F.col("dom.error").alias("_parse_error"),
    )
    if main:                                  # F2: the scraper's text clean decodes entities a second time
        extracted = extracted.withColumn("_main_text", html_unescape(F.col("_main_text")))
    content = struct(("text", clean_text_sql("_main_text")), ("headings", "_content.headings"),
                     ("paragraphs", "_content.paragraphs"), ("lists", "_content.lists"))
    parts = {"links": ["url", "text", "title", "target", "is_external"], "images": ["src", "alt", "title"],
             "forms": ["action", "method", "id", "class_name", "fields"]}
    bad = " OR ".join(f"exists(_{name}, x -> NOT x.ok)" for name in parts if name in fields)
    error = f"coalesce(_parse_error, CASE WHEN {bad} THEN 'ValueError: Invalid IPv6 URL' END)" if bad else "_parse_error"
    return extracted.select(
        *keep, *(["metadata"] if "metadata" in fields else []),
        *([expr(f"CASE WHEN _content IS NOT NULL THEN {content} END").alias("content"), "main_selector"] if main else []),
        *[expr(f"transform(_{name}, x -> {struct(*[(f, f'x.{f}') for f in names])})").alias(name)
          for name, names in parts.items() if name in fields],
        *(["frameworks"] if "frameworks" in fields else []), "text_strip_length", expr(error).alias("extract_error"),
    )


def paragraph_count_sql(d: str, m: str) -> str:
    """Number of H8 paragraphs, without their texts in an array."""
    def long_enough(b, n):
        return f"({is_tag(n, 'p')} AND length({py_strip_sql(span(b, n))}) > {PARAGRAPH_MIN_CHARS})"
    return with_bytes(d, lambda b: f"size({where(subtree(d, m), lambda n: long_enough(b, n))})")


def tag_count_sql(nodes: str, tags: list[str]) -> str:
    return f"size({where(nodes, lambda n: f'{n}.tag IN ({qlist(tags)})')})"


def dom_to_facts(parsed: DataFrame, mode: str = "static", url_col: str = "url") -> DataFrame:
    """What the page table and the statistics need, counted from the nodes:
    ``title``, ``main_text`` (as extracted), ``paragraph_count``,
    ``heading_count``, ``form_count`` and the distinct absolute URLs of links
    (``link_urls``) and images (``image_urls``); no record is built."""
    url = f"coalesce(`{url_col}`, '')"
    keep = [c for c in parsed.columns if c != "dom"]
    staged = parsed.select("*", expr(url_split_sql(url)).alias("_base"), expr(main_content_sql("dom", mode)).alias("_main"))
    m = "_main.node"

    def joined(tag, name):
        found = where("dom.nodes", lambda n: f"({is_tag(n, tag)} AND {has_attr(n, name)})")
        return f"array_distinct(transform({found}, {lam(lambda n: url_join_parts_sql(url, '_base', attr(n, name)))}))"

    out = staged.select(
        *keep, "_base", expr(title_sql("dom", mode)).alias("title"),
        expr(f"CASE WHEN {m} IS NOT NULL THEN {node_text('dom', m)} END").alias("main_text"),
        expr(f"CASE WHEN {m} IS NOT NULL THEN {paragraph_count_sql('dom', m)} ELSE 0 END").alias("paragraph_count"),
        expr(f"CASE WHEN {m} IS NOT NULL THEN {tag_count_sql(subtree('dom', m), HEADING_TAGS)} ELSE 0 END").alias("heading_count"),
        expr(f"greatest({tag_count_sql('dom.nodes', ['form'])}, 0)").alias("form_count"),
        expr(joined("a", "href")).alias("link_urls"), expr(joined("img", "src")).alias("image_urls"))
    return out.withColumn("main_text", html_unescape(F.col("main_text")))


def extract_raw(pages: DataFrame, mode: str = "static", html_col: str = "html",
                tags: frozenset[str] | None = None, fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """H0: pages(page_id, url, html, ...) → RAW columns (one parse per page).
    ``tags``: the only elements the wanted columns read, so that the others
    stay in Python; columns of other elements are then not to be used.
    ``fields``: the only record columns to build."""
    return dom_to_raw(parse_dom(pages, html_col=html_col, tags=tags), mode, fields=fields)


# Column wrappers for single extractors over a ``dom`` column -------------

def extract_title(dom: str = "dom", mode: str = "static"):
    return expr(title_sql(dom, mode))


def extract_language(dom: str = "dom"):
    return expr(language_sql(dom))


def select_main_content(dom: str = "dom", mode: str = "static"):
    return expr(main_content_sql(dom, mode))
