"""Helpers for writing Spark SQL expressions as text.

The library's scalar and page operators are Spark SQL expressions
(``regexp_extract``, ``transform``/``filter``/``aggregate`` lambdas, CASE
WHEN …).  They are produced as SQL text and turned into a Column with one
``F.expr`` call: a tree of thousands of nodes built Column-by-Column would
cost thousands of driver↔JVM round trips; as text it is one parse.

Public functions take *SQL expressions* as arguments — a column name is
the simplest one.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

_ids = itertools.count()


def fresh() -> str:
    """A lambda-variable name that cannot clash with another."""
    return f"_v{next(_ids)}"


def q(s: str) -> str:
    """A Spark SQL string literal for ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qlist(values) -> str:
    return ", ".join(q(v) for v in values)


def let(value: str, body) -> str:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark SQL has no LET; binding through a one-element ``transform`` keeps
    the expression linear instead of copying ``value`` into every place
    ``body`` uses it."""
    v = fresh()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def lam(body, n: int = 1) -> str:
    vs = [fresh() for _ in range(n)]
    head = vs[0] if n == 1 else "(" + ", ".join(vs) + ")"
    return f"{head} -> {body(*vs)}"


def struct(*pairs) -> str:
    """named_struct from (name, sql) pairs."""
    return "named_struct(" + ", ".join(f"{q(k)}, {v}" for k, v in pairs) + ")"


def arg(x) -> str:
    """Accept a column name / SQL expression string."""
    if isinstance(x, Column):
        raise TypeError("pass a column name or a Spark SQL expression string")
    return x


def expr(sql: str) -> Column:
    return F.expr(sql)
