"""Flat forms of D1/D2, F6/F7 and W1/W2, for link/image rows that are
already one row per item (e.g. read back from CSV) rather than arrays
inside a page row.

Rows carry (page_id, pos, base_url, …).  De-duplication keeps the first
occurrence per (page, exact key) with ``row_number`` over that pair —
groups are bounded by the number of copies of one URL on one page — and
numbering is a ``row_number`` over the page's surviving rows.  Never
``dropDuplicates``: it keeps an arbitrary survivor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import expr, let
from ..functions.text import py_strip_sql
from ..functions.urls import has_pseudo_prefix_sql, is_external_sql, is_valid_url_sql, url_join_sql, \
    url_split_sql


def dedup_first_flat(rows: DataFrame, key: str, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """D1/D2 (flat): first row per (page, key) in document order; NULL keys
    dropped."""
    w = Window.partitionBy(page, key).orderBy(pos)
    return rows.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)) \
        .filter("_rn = 1").drop("_rn")


def normalize_links_flat(rows: DataFrame, url_col: str = "url", base_col: str = "base_url") -> DataFrame:
    """F6 (flat): strip, drop pseudo/fragment links, resolve non-http(s)
    against the page, keep valid URLs."""
    def fix(raw):
        absolute = (f"CASE WHEN startswith({raw}, 'http://') OR startswith({raw}, 'https://') THEN {raw} "
                    f"ELSE {url_join_sql(base_col, raw)} END")
        return f"CASE WHEN {raw} != '' AND NOT {has_pseudo_prefix_sql(raw)} THEN {absolute} END"
    out = rows.withColumn(url_col, expr(let(py_strip_sql(f"coalesce({url_col}, '')"), fix)))
    return out.filter(expr(f"{url_col} IS NOT NULL AND {is_valid_url_sql(url_col)}"))


def normalize_images_flat(rows: DataFrame, src_col: str = "src", base_col: str = "base_url") -> DataFrame:
    """F7 (flat): strip, drop empty, always resolve, keep http(s) results."""
    def fix(raw):
        return f"CASE WHEN {raw} != '' AND {url_split_sql(raw)}.ok THEN {url_join_sql(base_col, raw)} END"
    out = rows.withColumn(src_col, expr(let(py_strip_sql(f"coalesce({src_col}, '')"), fix)))
    return out.filter(expr(f"coalesce(startswith({src_col}, 'http://') OR startswith({src_col}, 'https://'), false)"))


def number_valid_flat(rows: DataFrame, url_col: str, base_col: str = "base_url", page: str = "page_id",
                      pos: str = "pos", number_col: str = "n") -> DataFrame:
    """W1/W2 (flat): keep rows whose URL is valid (P3), number them 1..n per
    page in document order, flag external ones (F5)."""
    valid = rows.filter(expr(is_valid_url_sql(url_col)))
    w = Window.partitionBy(page).orderBy(pos)
    return valid.withColumn(number_col, F.row_number().over(w)) \
        .withColumn("is_external", expr(is_external_sql(url_col, base_col)))
