"""C2 — the whole scrape as one DataFrame job.

``scrape_pages(pages, run_ts, robots)`` follows the order of the gates: request
check (P9) → robots (J1) → captcha (P14) → fetch status (P20) → the scraper's
own captcha re-check → content (P1) → validation (P2).  The first failing gate
names the error (P19).

What needs no page content is decided on the raw rows: request, robots,
headers and status.  Rows that fail there become error rows at once, and only
the others are parsed (H0), routed per page to the static or the dynamic
dialect (P16) and processed (C1).  The parsed page is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import expr, q
from ..functions.urls import validate_request_sql
from ..operators import gates as G
from ..operators.dom import parse_dom
from ..operators.extract import dom_to_raw
from ..operators.process import has_content_sql, process_records
from ..sources.pages import with_fetch_defaults

#: Robots files are broadcast up to so many origins; beyond, Spark chooses.
BROADCAST_ORIGINS = 20_000


def raw_gates(pages: DataFrame, robots: DataFrame | None = None, scraping_type: str | None = None) -> DataFrame:
    """Gate columns that need no parse: ``request_error``, ``robots_allowed``,
    ``crawl_delay``, ``_markup_dynamic`` and the request's ``scraping_type``
    (``scraping_type`` for all pages, or the column of that name, else static)."""
    pages = with_fetch_defaults(pages)
    if scraping_type is not None or "scraping_type" not in pages.columns:
        pages = pages.withColumn("scraping_type", F.lit(scraping_type or "static"))
    checked = pages.select("*", expr(f"nullif({validate_request_sql('url', 'scraping_type')}.message, '')").alias("request_error"),
                           expr(G.markup_markers_sql("html")).alias("_markup_dynamic"))
    if robots is None:
        return checked.withColumn("robots_allowed", F.lit(True)).withColumn("crawl_delay", F.lit(G.DEFAULT_CRAWL_DELAY))
    small = not robots.isStreaming and robots.limit(BROADCAST_ORIGINS + 1).count() <= BROADCAST_ORIGINS
    return G.robots_allowed(checked, robots, "url", broadcast=small).withColumnRenamed("allowed", "robots_allowed")


#: The error of a raw row, or NULL if the page has to be looked at.
EARLY_ERROR = (
    f"CASE WHEN request_error IS NOT NULL THEN request_error "
    f"WHEN NOT robots_allowed THEN {q(G.MSG_ROBOTS)} "
    f"WHEN {G.blocked_by_headers_sql('headers')} "
    f"OR {G.blocked_by_status_sql('coalesce(http_status_code, 200)')} = 'blocked' THEN {q(G.MSG_CAPTCHA)} "
    f"WHEN NOT {G.fetch_ok_sql('http_status_code')} THEN {q(G.MSG_NO_DATA)} END")


def gate_columns(pages: DataFrame) -> DataFrame:
    """Parse and add the captcha gate of the page (P14) and the scrapers' own
    re-checks: static words, or rendered selectors and words."""
    parsed = parse_dom(with_fetch_defaults(pages))
    return parsed.select(
        "*",
        expr(G.gate_captcha_sql("dom", "http_status_code", "headers")).alias("captcha"),
        expr(f"{G.captcha_by_text_sql('dom.text', G.STATIC_FETCH_KEYWORDS)} IS NOT NULL").alias("_static_recheck"),
        expr(f"{G.captcha_by_selector_sql('dom', G.RENDERED_CAPTCHA_SELECTORS)} IS NOT NULL OR "
             f"{G.captcha_by_text_sql('dom.text', G.RENDERED_KEYWORDS)} IS NOT NULL").alias("_dynamic_recheck"),
    )


def scrape_pages(pages: DataFrame, run_ts: str, robots: DataFrame | None = None,
                 scraping_type: str | None = None) -> DataFrame:
    """One row per page with ``status`` ('success'/'error'), ``error``,
    ``rendering`` and ``route`` of the pages that were parsed and, for
    successes, the processed record columns."""
    early = raw_gates(pages, robots, scraping_type).withColumn("early_error", expr(EARLY_ERROR))
    survivors = early.filter("early_error IS NULL")
    raw = dom_to_raw(gate_columns(survivors), "routed")
    rec = process_records(raw, run_ts)
    error = (f"CASE WHEN captcha.has_captcha THEN {q(G.MSG_CAPTCHA)} "
             f"WHEN CASE WHEN route = 'dynamic' THEN _dynamic_recheck ELSE _static_recheck END "
             f"OR extract_error IS NOT NULL OR NOT {has_content_sql('url', 'content')} THEN {q(G.MSG_NO_DATA)} "
             f"WHEN NOT valid THEN concat_ws('; ', validation.errors) END")
    parsed = rec.withColumn("error", expr(error))
    # Rejected rows: the same envelope with no record.
    rejected = process_rejected(early.filter("early_error IS NOT NULL"), run_ts)
    both = parsed.unionByName(rejected, allowMissingColumns=True)
    return both.withColumn("status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error"))) \
        .drop("early_error")


def process_rejected(rows: DataFrame, run_ts: str) -> DataFrame:
    """Rows that a raw gate rejects, as error records with zeroed counts."""
    from ..operators.process import RUN_COUNTERS, assign_page_id_sql, normalize_scraped_at_sql

    is_text = rows.schema["scraped_at"].dataType.typeName() == "string"
    keep = [c for c in rows.columns if c not in ("html", "page_id", "scraped_at")]
    out = rows.withColumn("_at", expr(normalize_scraped_at_sql("scraped_at", run_ts, is_text)))
    return out.select(*keep, F.col("_at").alias("scraped_at"), expr(assign_page_id_sql("page_id", "url", "_at")).alias("page_id"),
                      F.col("early_error").alias("error"), F.lit(False).alias("valid"),
                      *[F.lit(0).alias(c) for c in RUN_COUNTERS if c in ("word_count", "character_count")])
