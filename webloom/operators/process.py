"""C1 — validate, clean, de-duplicate, normalise and flatten RAW records.

Everything here is page-local: each step rewrites the arrays of one row
with higher-order functions, so the whole of ``process`` compiles to one
stage with **no shuffle**; the flat tables come from ``posexplode``.

Order (as in the reference processor): P2 validation → cleaning (F1 on
text, paragraphs, headings and top-level metadata strings) → D1/D2
first-occurrence de-duplication → F6/F7 URL normalisation → tables
(A1, W1, W2, W3) and statistics (A2, A3).  Invalid records leave through
``errors`` (P18).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import expr, fresh, lam, let, q, struct
from ..functions.text import clean_text_sql, py_strip_sql, word_count_sql
from ..functions.urls import has_pseudo_prefix_sql, url_join_parts_sql, url_split_sql, valid_external_sql
from .extract import META_FIELDS, RAW_DYNAMIC_FIELDS, RAW_STATIC_FIELDS

# Validation messages.
MSG_MISSING_URL = "Missing URL"
MSG_NO_CONTENT = "No content extracted"
MSG_NO_TITLE = "No title found"

def _arr(c: str) -> str:
    return f"coalesce({c}, array())"


def _nonempty(c: str) -> str:
    return f"coalesce({c} != '', false)"


# --------------------------------------------------------------------------
# P2

def validate_raw_sql(url: str, content: str, metadata: str) -> str:
    """struct<valid, errors[], warnings[]>."""
    no_content = (f"(NOT {_nonempty(f'{content}.text')} AND size({_arr(f'{content}.headings')}) = 0 "
                  f"AND size({_arr(f'{content}.paragraphs')}) = 0)")
    errors = f"array_compact(array(CASE WHEN NOT {_nonempty(url)} THEN {q(MSG_MISSING_URL)} END))"
    warnings = (f"array_compact(array(CASE WHEN {no_content} THEN {q(MSG_NO_CONTENT)} END, "
                f"CASE WHEN NOT {_nonempty(f'{metadata}.title')} THEN {q(MSG_NO_TITLE)} END))")
    return let(errors, lambda e: struct(("valid", f"size({e}) = 0"), ("errors", e), ("warnings", warnings)))


def has_content_sql(url: str, content: str) -> str:
    """Url non-empty and some text, heading or paragraph extracted."""
    return (f"({_nonempty(url)} AND ({_nonempty(f'{content}.text')} OR size({_arr(f'{content}.headings')}) > 0 "
            f"OR size({_arr(f'{content}.paragraphs')}) > 0))")


# --------------------------------------------------------------------------
# cleaning (F1, F18, F19, P5)

def clean_metadata_sql(md: str) -> str:
    """F1 on the top-level string fields; open_graph untouched."""
    fields = ["title"] + META_FIELDS + ["language", "url", "domain"]
    return struct(*[(f, clean_text_sql(f"{md}.{f}")) for f in fields], ("open_graph", f"{md}.open_graph"))


def clean_headings_sql(hs: str) -> str:
    """F1 on every heading text (blank ones kept)."""
    return f"transform({hs}, {lam(lambda h: struct(('level', f'{h}.level'), ('text', clean_text_sql(f'{h}.text')), ('id', f'{h}.id'), ('class', f'{h}.class')))})"


def drop_blank_paragraphs_sql(ps: str) -> str:
    """P5: drop blank paragraphs, F1 on the rest."""
    def not_blank(p):
        return f"{py_strip_sql(p)} != ''"
    kept = f"filter({ps}, {lam(not_blank)})"
    return f"transform({kept}, {lam(clean_text_sql)})"


def clean_content_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN {struct(('text', clean_text_sql(f'{c}.text')), ('headings', clean_headings_sql(f'{c}.headings')), ('paragraphs', drop_blank_paragraphs_sql(f'{c}.paragraphs')), ('lists', f'{c}.lists'))} END")


# --------------------------------------------------------------------------
# D1 / D2 — first occurrence per exact key, document order kept

def dedup_first_sql(items: str, key: str) -> str:
    """Keep the first item for each exact ``key`` value, in original order;
    items whose key is NULL are dropped.  O(n log n) per page: sort
    (key, position), keep run heads, restore position order."""
    def run(arr):
        x, i = fresh(), fresh()
        tagged = f"filter(transform({arr}, ({x}, {i}) -> {struct(('k', f'{x}.{key}'), ('p', i))}), t -> t.k IS NOT NULL)"

        def heads(srt):
            t, j = fresh(), fresh()
            firsts = f"filter({srt}, ({t}, {j}) -> {j} = 0 OR element_at({srt}, greatest({j}, 1)).k != {t}.k)"
            return f"array_sort(transform({firsts}, h -> h.p))"
        keep = let(f"array_sort({tagged})", heads)
        return f"transform({keep}, p -> element_at({arr}, p + 1))"
    return let(items, run)


# --------------------------------------------------------------------------
# F6 / F7 — URL normalisation

def normalize_links_sql(links: str, base: str, b: str) -> str:
    """strip; drop empty and pseudo/fragment links (P4); keep http(s)://
    URLs as they are (case-sensitive test), resolve the rest against the
    page; drop what is not a valid URL (P3).  ``outside`` is F5 of the result."""
    def norm(l):
        def fix(raw):
            absolute = (f"CASE WHEN startswith({raw}, 'http://') OR startswith({raw}, 'https://') THEN {raw} "
                        f"ELSE {url_join_parts_sql(base, b, raw)} END")
            return f"CASE WHEN {raw} != '' AND NOT {has_pseudo_prefix_sql(raw)} THEN {absolute} END"
        return let(let(py_strip_sql(f"{l}.url"), fix), lambda u: struct(
            ("url", u), ("text", f"{l}.text"), ("title", f"{l}.title"), ("target", f"{l}.target"),
            ("is_external", f"{l}.is_external"), ("outside", valid_external_sql(u, b))))
    return f"filter(transform({links}, {lam(norm)}), l -> l.outside IS NOT NULL)"


def normalize_images_sql(images: str, base: str, b: str) -> str:
    """strip; drop empty; always resolve against the page; keep what
    starts with http:// or https://."""
    def norm(i):
        def fix(raw):
            return f"CASE WHEN {raw} != '' AND {url_split_sql(raw)}.ok THEN {url_join_parts_sql(base, b, raw)} END"
        return struct(("src", let(py_strip_sql(f"{i}.src"), fix)), ("alt", f"{i}.alt"), ("title", f"{i}.title"))

    def keep(i):
        return f"coalesce(startswith({i}.src, 'http://') OR startswith({i}.src, 'https://'), false)"
    return f"filter(transform({images}, {lam(norm)}), {lam(keep)})"


def kept_links_sql(urls: str, base: str, b: str) -> str:
    """F6 on bare URLs: those that ``normalize_links_sql`` would keep."""
    def kept(u):
        def fix(raw):
            absolute = (f"CASE WHEN startswith({raw}, 'http://') OR startswith({raw}, 'https://') THEN {raw} "
                        f"ELSE {url_join_parts_sql(base, b, raw)} END")
            return f"CASE WHEN {raw} != '' AND NOT {has_pseudo_prefix_sql(raw)} THEN {absolute} END"
        return f"{valid_external_sql(let(py_strip_sql(u), fix), b)} IS NOT NULL"
    return f"filter({urls}, {lam(kept)})"


def kept_images_sql(urls: str, base: str, b: str) -> str:
    """F7 on bare URLs: those that ``normalize_images_sql`` would keep."""
    def kept(u):
        def fix(raw):
            return f"CASE WHEN {raw} != '' AND {url_split_sql(raw)}.ok THEN {url_join_parts_sql(base, b, raw)} END"
        return let(let(py_strip_sql(u), fix), lambda x: f"coalesce(startswith({x}, 'http://') OR startswith({x}, 'https://'), false)")
    return f"filter({urls}, {lam(kept)})"


# --------------------------------------------------------------------------
# F9 / F10 / F11

def normalize_scraped_at_sql(s: str, run_ts: str, is_text: bool = True) -> str:
    """missing, or text shorter than 20 characters → the run timestamp.
    The length rule is about ISO text; a non-NULL timestamp is kept."""
    if not is_text:
        return f"coalesce(CAST({s} AS TIMESTAMP), to_timestamp({q(run_ts)}))"
    return f"CASE WHEN {s} IS NULL OR length({s}) < 20 THEN to_timestamp({q(run_ts)}) ELSE to_timestamp({s}) END"


def assign_page_id_sql(session_id: str, url: str, scraped_at: str) -> str:
    """the session id, else a deterministic id from url and time
    (retry-safe, unlike a random UUID)."""
    return (f"coalesce(CAST({session_id} AS STRING), "
            f"sha2(concat_ws('#', coalesce({url}, ''), CAST({scraped_at} AS STRING)), 256))")


def image_id_sql(page_id: str, n: str) -> str:
    """``{page_id}_img_{n}``."""
    return f"concat({page_id}, '_img_', CAST({n} AS STRING))"


# --------------------------------------------------------------------------
# C1

@dataclass
class Processed:
    """The outputs of ``process``; all derive from ``records`` (one row per
    input page).  Persist or stage ``records`` when writing several."""
    records: DataFrame
    pages: DataFrame
    links: DataFrame
    images: DataFrame
    errors: DataFrame
    summary: DataFrame


def _opt(df: DataFrame, name: str, typ: str) -> str:
    return f"`{name}`" if name in df.columns else f"CAST(NULL AS {typ})"


def _is_text(df: DataFrame, name: str) -> bool:
    return name not in df.columns or df.schema[name].dataType.typeName() == "string"


def _total_fields(columns, mode: str):
    if "route" in columns:
        return F.when(F.col("route") == "dynamic", RAW_DYNAMIC_FIELDS).otherwise(RAW_STATIC_FIELDS)
    return F.lit(RAW_DYNAMIC_FIELDS if mode == "dynamic" else RAW_STATIC_FIELDS)


def process_records(raw: DataFrame, run_ts: str, mode: str = "static") -> DataFrame:
    """P2 → clean → dedup → normalise, one output row per RAW row.

    Adds ``page_id`` (string), ``scraped_at`` (timestamp), ``validation``,
    ``valid``, normalised ``content``/``metadata``/``links``/``images``, the
    numbered-to-be ``link_rows``/``image_rows``, and counts.  A RAW table that
    was asked for some fields only gives what follows from those (``validation``
    needs content and metadata)."""
    has = set(raw.columns)
    drop = {"content", "metadata", "links", "images", "page_id", "scraped_at"}
    rest = [c for c in raw.columns if c not in drop]
    own = [c for c in ("content", "metadata", "links", "images") if c in has]
    checked = {"content", "metadata"} <= has
    staged = raw.select(
        *rest, *own,
        *([expr(validate_raw_sql("url", "content", "metadata")).alias("validation")] if checked else []),
        expr(normalize_scraped_at_sql(_opt(raw, "scraped_at", "STRING"), run_ts, _is_text(raw, "scraped_at"))).alias("scraped_at"),
        expr(_opt(raw, "page_id", "STRING")).alias("_sid"),
        expr(url_split_sql("coalesce(url, '')")).alias("_base"),
    )
    base = "coalesce(url, '')"
    rewritten = {"content": lambda: clean_content_sql("content"), "metadata": lambda: clean_metadata_sql("metadata"),
                 "links": lambda: normalize_links_sql(dedup_first_sql(_arr("links"), "url"), base, "_base"),
                 "images": lambda: normalize_images_sql(dedup_first_sql(_arr("images"), "src"), base, "_base")}
    cleaned = staged.select(
        *rest, *(["validation"] if checked else []), "scraped_at",
        expr(assign_page_id_sql("_sid", "url", "scraped_at")).alias("page_id"),
        *[expr(rewritten[c]()).alias(c) for c in own], "_base")

    def link_row(l):
        return struct(("link_url", f"{l}.url"), ("link_text", f"coalesce({l}.text, '')"),
                      ("link_title", f"coalesce({l}.title, '')"), ("is_external", f"{l}.outside"))

    def image_row(i):
        return let(valid_external_sql(f"{i}.src", "_base"), lambda x: f"CASE WHEN {x} IS NOT NULL THEN " + struct(
            ("image_src", f"{i}.src"), ("image_alt", f"coalesce({i}.alt, '')"), ("is_external", x)) + " END")
    text = "coalesce(content.text, '')"
    added = {
        "metadata": {"title": "coalesce(metadata.title, '')"},
        "links": {"link_rows": f"transform(links, {lam(link_row)})",     # F6 has applied P3 to links already
                  "link_count": "size(links)"},
        "images": {"image_rows": f"filter(transform(images, {lam(image_row)}), i -> i IS NOT NULL)", "image_count": "size(images)"},
        "forms": {"form_count": "size(coalesce(forms, array()))"},
        "content": {"character_count": f"length({text})", "word_count": word_count_sql(text),
                    "paragraph_count": "size(coalesce(content.paragraphs, array()))",
                    "heading_count": "size(coalesce(content.headings, array()))"},
    }
    out = cleaned.select(
        "*", expr(_nonempty("url")).alias("valid"),        # P2 without its warnings, which read the texts
        _total_fields(raw.columns, mode).alias("total_fields"),
        *[expr(sql).alias(name) for c, more in added.items() if c in has for name, sql in more.items()])
    if "links" in has:
        link = struct(*[(f, f"l.{f}") for f in ("url", "text", "title", "target", "is_external")])
        out = out.withColumn("links", expr(f"transform(links, l -> {link})"))
    return out.drop("_base")


def page_facts(facts: DataFrame, run_ts: str, mode: str = "static") -> DataFrame:
    """What A1-A3 read of a record, from ``dom_to_facts``: the same title,
    lengths and counts as ``process_records`` gives, without cleaning and
    keeping the texts, links and images that are only counted."""
    own = ["_base", "main_text", "link_urls", "image_urls", "page_id", "scraped_at"]
    rest = [c for c in facts.columns if c not in own]
    base = "coalesce(url, '')"
    staged = facts.select(
        *[c for c in rest if c != "title"], expr(f"coalesce({clean_text_sql('title')}, '')").alias("title"),
        expr(normalize_scraped_at_sql(_opt(facts, "scraped_at", "STRING"), run_ts, _is_text(facts, "scraped_at"))).alias("scraped_at"),
        expr(_opt(facts, "page_id", "STRING")).alias("_sid"),
        expr(f"coalesce({clean_text_sql(clean_text_sql('main_text'))}, '')").alias("_text"),   # F1 of the scraper, then of the processor
        expr(f"greatest(size({kept_links_sql('link_urls', base, '_base')}), 0)").alias("link_count"),
        expr(f"greatest(size({kept_images_sql('image_urls', base, '_base')}), 0)").alias("image_count"))
    return staged.select(
        *rest, "scraped_at", expr(assign_page_id_sql("_sid", "url", "scraped_at")).alias("page_id"),
        expr(_nonempty("url")).alias("valid"), _total_fields(facts.columns, mode).alias("total_fields"),
        expr("length(_text)").alias("character_count"), expr(word_count_sql("_text")).alias("word_count"),
        "link_count", "image_count")


def _fetch_field(rec: DataFrame, name: str, default: int, fill: bool) -> str:
    """F8: an absent column takes the default; NULL stays NULL unless ``fill``."""
    if name not in rec.columns:
        return str(default)
    return f"coalesce(CAST(`{name}` AS INT), {default})" if fill else f"CAST(`{name}` AS INT)"


def pages_table(rec: DataFrame, fill_http_defaults: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A1: one row per valid page; ``rec``: records or page facts.  ``carry``:
    columns to keep as well."""
    return rec.filter("valid").select(
        "page_id", "url", "title", "scraped_at", F.col("character_count").alias("text_length"),
        "paragraph_count", "heading_count", "image_count", "form_count",
        expr(_fetch_field(rec, "http_status_code", 200, fill_http_defaults)).alias("http_status_code"),
        expr(_fetch_field(rec, "response_time_ms", 0, fill_http_defaults)).alias("response_time_ms"), *carry,
    )


def each(df: DataFrame, array, *keep: str) -> DataFrame:
    """``keep``, and ``pos`` and ``x`` of every element of an array.  An outer
    generator, filtered after: for an inner one the optimizer adds a filter on
    the array's size below it, which evaluates the array's expression again."""
    return df.select(*keep, F.posexplode_outer(array).alias("pos", "x")).filter("pos IS NOT NULL")


def links_table(rec: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Dense 1..n numbering after filtering, in document order (page-local
    ``posexplode``; no shuffle).  ``carry``: page columns to keep as well."""
    return each(rec.filter("valid"), "link_rows", "page_id", "scraped_at", *carry).select(
        "page_id", (F.col("pos") + 1).alias("link_number"), "x.link_url", "x.link_text", "x.link_title",
        "x.is_external", "scraped_at", *carry)


def images_table(rec: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """As W1 for images, plus ``image_id``."""
    return each(rec.filter("valid"), "image_rows", "page_id", "scraped_at", *carry).select(
        expr(image_id_sql("page_id", "pos + 1")).alias("image_id"), "page_id", "x.image_src", "x.image_alt",
        "x.is_external", "scraped_at", *carry)


def headings_table(rec: DataFrame) -> DataFrame:
    """heading_number 1..n with level and text."""
    return each(rec.filter("valid"), "content.headings", "page_id", "url") \
        .select("page_id", "url", (F.col("pos") + 1).alias("heading_number"),
                F.col("x.level").alias("heading_level"), F.col("x.text").alias("heading_text"))


def page_statistics(rec: DataFrame) -> DataFrame:
    """A2 (statistics) and A3 (run counters) for each valid page; ``rec``:
    records or page facts."""
    return rec.filter("valid").select(
        "page_id", "url", "total_fields", F.col("character_count").alias("content_length"),
        F.col("paragraph_count").alias("paragraphs_count"), F.col("heading_count").alias("headings_count"),
        F.col("link_count").alias("links_count"), F.col("image_count").alias("images_count"),
        F.col("form_count").alias("forms_count"), "word_count", "character_count",
        F.lit(1).alias("pages_scraped"), F.col("link_count").alias("links_found"),
        F.col("image_count").alias("images_found"), F.col("heading_count").alias("headings_found"),
        F.col("paragraph_count").alias("paragraphs_found"), F.col("form_count").alias("forms_found"),
    )


# The run counters.
RUN_COUNTERS = ["pages_scraped", "links_found", "images_found", "headings_found", "paragraphs_found", "forms_found",
                "word_count", "character_count"]


def run_summary(rec: DataFrame, by: str = "host") -> DataFrame:
    """A3 over many pages: the eight counters summed by host."""
    stats = page_statistics(rec).withColumn(by, expr(f"{url_split_sql('url')}.netloc"))
    return stats.groupBy(by).agg(*[F.sum(c).cast("long").alias(c) for c in RUN_COUNTERS])


def page_children(pages: DataFrame, children: DataFrame) -> DataFrame:
    """J4 ``page_links`` / ``page_images``: the pages table with its child rows;
    pages without children stay, their child columns NULL.  Tables written by
    ``write_bucketed`` with the same buckets join without moving a row."""
    same = [c for c in children.columns if c in pages.columns and c != "page_id"]
    return pages.join(children.drop(*same), "page_id", "left")


def page_children_local(rec: DataFrame, child: str = "links", fill_http_defaults: bool = False) -> DataFrame:
    """J4 before anything is written: the same rows as ``page_children`` gives
    for ``pages_table`` and ``links_table`` (or ``images_table``) of ``rec``,
    from one parse and without an exchange, as a page's children are in its row."""
    rows = {"links": "link_rows", "images": "image_rows"}[child]
    page = pages_table(rec.withColumn("_rows", F.col(rows)), fill_http_defaults, carry=("_rows",))
    columns = [c for c in page.columns if c != "_rows"]
    out = page.select(*columns, F.posexplode_outer("_rows").alias("pos", "r"))
    if child == "links":
        return out.select(*columns, (F.col("pos") + 1).alias("link_number"), "r.link_url", "r.link_text", "r.link_title", "r.is_external")
    numbered = F.when(F.col("pos").isNotNull(), expr(image_id_sql("page_id", "pos + 1")))
    return out.select(*columns, numbered.alias("image_id"), "r.image_src", "r.image_alt", "r.is_external")


def write_bucketed(tables: dict[str, DataFrame], prefix: str, path: str, buckets: int, key: str = "page_id") -> dict[str, DataFrame]:
    """Write tables bucketed (and sorted) by ``key`` as ``{prefix}_{name}`` with
    their files under ``path``, and return them as read from the catalog: joins
    between them by the key need no exchange."""
    out = {}
    for name, df in tables.items():
        # One task writes a bucket, else each task writes a file of every bucket.
        (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}"))
        out[name] = df.sparkSession.table(f"{prefix}_{name}")
    return out


def framework_counts(raw: DataFrame) -> DataFrame:
    """Pages per client framework (only markers that are there)."""
    return (raw.select(F.explode(F.map_keys(F.map_filter("frameworks", lambda k, v: v))).alias("framework"))
            .groupBy("framework").agg(F.count(F.lit(1)).alias("pages")))


def errors_table(rec: DataFrame) -> DataFrame:
    """Records failing validation, with zeroed counters."""
    return rec.filter(~F.col("valid")).select(
        "page_id",
        expr("coalesce(url, '')").alias("url"),
        F.lit("error").alias("status"),
        expr("concat_ws('; ', validation.errors)").alias("error"),
        F.col("validation.errors").alias("errors"),
        "scraped_at",
        *[F.lit(0).alias(c) for c in RUN_COUNTERS],
    )


def process(raw: DataFrame, run_ts: str, mode: str = "static") -> Processed:
    """RAW → pages, links, images, errors and per-page summary."""
    rec = process_records(raw, run_ts, mode)
    return Processed(rec, pages_table(rec), links_table(rec), images_table(rec), errors_table(rec),
                     page_statistics(rec))
