"""Text scalars (F1, F2, F12-F17, F20) as Spark SQL expressions.

All of these stay inside the JVM (regexp_replace / length / split), so they
are evaluated by Catalyst and whole-stage codegen.  The one exception is the
HTML entity decoder ``html_unescape`` (F2): the HTML5 entity table and its
longest-prefix rule are not expressible with Spark built-ins, so it is an
Arrow-batched pandas UDF fed only the rows that contain an ``&``.

``*_sql`` functions return SQL text (to compose); the plain names return a
Column.  Arguments are column names or SQL expressions.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import arg, expr, fresh, q


def _ranges(codepoints):
    out = []
    for c in sorted(codepoints):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


def _java_class(codepoints) -> str:
    return "".join("\\x{%X}" % a if a == b else "\\x{%X}-\\x{%X}" % (a, b) for a, b in _ranges(codepoints))


def chars_literal(codepoints) -> str:
    """A Spark SQL string literal holding exactly these characters."""
    return "'" + "".join("\\u%04x" % c for c in codepoints) + "'"


# Python's notion of whitespace (str.isspace / str.split /
# str.strip / re \s).  Spark's own \s and trim() are ASCII-only.
PY_WS_CODEPOINTS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PY_WS = "[" + _java_class(PY_WS_CODEPOINTS) + "]"

# The control-character class removed by the clean-text rule,
# and the C0-control-or-space set stripped by URL splitting.
CONTROL_CODEPOINTS = list(range(0x00, 0x09)) + [0x0B, 0x0C] + list(range(0x0E, 0x20)) + [0x7F]
C0_OR_SPACE = "[\\x00-\\x20]"

_WS_LITERAL = chars_literal(PY_WS_CODEPOINTS)
_CONTROL_LITERAL = chars_literal(CONTROL_CODEPOINTS)


def py_strip_sql(s: str) -> str:
    """``str.strip()`` with Python's Unicode whitespace set (native btrim)."""
    return f"btrim({s}, {_WS_LITERAL})"


def clean_text_sql(s: str) -> str:
    """collapse whitespace runs to one space, then delete control
    characters (``translate``), then strip.  NULL stays NULL."""
    collapsed = f"regexp_replace({s}, {q(PY_WS + '+')}, ' ')"
    return py_strip_sql(f"translate({collapsed}, {_CONTROL_LITERAL}, '')")


def word_count_sql(s: str) -> str:
    """``len(s.split())``; NULL/empty gives 0."""
    w = fresh()
    spaced = f"regexp_replace(coalesce({s}, ''), {q(PY_WS + '+')}, ' ')"
    return f"size(filter(split({spaced}, ' '), {w} -> {w} != ''))"


def truncate_sql(s: str, n: int) -> str:
    """first n characters plus '...' when longer."""
    return f"CASE WHEN length({s}) > {n} THEN concat(substring({s}, 1, {n}), '...') ELSE {s} END"


def or_na_sql(s: str) -> str:
    """empty or missing becomes 'N/A'."""
    return f"coalesce(nullif({s}, ''), 'N/A')"


def status_badge_sql(s: str) -> str:
    """F16: status → badge class."""
    return (f"CASE {s} WHEN 'completed' THEN 'success' WHEN 'error' THEN 'danger' "
            f"WHEN 'running' THEN 'warning' ELSE 'info' END")


def format_timestamp_sql(ts: str) -> str:
    """'yyyy-MM-dd HH:mm:ss' or 'N/A'."""
    return f"coalesce(date_format({ts}, 'yyyy-MM-dd HH:mm:ss'), 'N/A')"


def split_classes_sql(s: str) -> str:
    """class attribute → array of tokens."""
    w = fresh()
    return f"filter(split(coalesce({s}, ''), {q(PY_WS + '+')}), {w} -> {w} != '')"


def has_token_sql(s: str, token: str) -> str:
    """True when the whitespace-separated attribute ``s`` contains ``token``."""
    import re
    pat = f"(^|{PY_WS}){re.escape(token)}({PY_WS}|$)"
    return f"coalesce({s} RLIKE {q(pat)}, false)"


# Column wrappers ---------------------------------------------------------

def py_strip(s) -> Column:
    return expr(py_strip_sql(arg(s)))


def clean_text(s) -> Column:
    return expr(clean_text_sql(arg(s)))


def char_length(s) -> Column:
    """number of code points."""
    return expr(f"length({arg(s)})")


def word_count(s) -> Column:
    return expr(word_count_sql(arg(s)))


def truncate(s, n: int) -> Column:
    return expr(truncate_sql(arg(s), n))


def or_na(s) -> Column:
    return expr(or_na_sql(arg(s)))


def title_case(s) -> Column:
    """F16: title-case a status word."""
    return expr(f"initcap({arg(s)})")


def status_badge(s) -> Column:
    return expr(status_badge_sql(arg(s)))


def format_timestamp(ts) -> Column:
    return expr(format_timestamp_sql(arg(ts)))


def split_classes(s) -> Column:
    return expr(split_classes_sql(arg(s)))


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


# An entity reference starts with '&' followed by '#' or a name character;
# '&' before whitespace, '<', '&' or ';' (or at the end) is left as it is.
_MAYBE_ENTITY = "&[^\\t\\n\\f <&;]"


def html_unescape(col: Column) -> Column:
    """decode HTML entities (``html.unescape``).  Only strings that can
    contain a reference cross into Python; the rest pass through unchanged."""
    needs = F.when(col.rlike(_MAYBE_ENTITY), col)
    return F.coalesce(_unescape_udf(needs), col)
