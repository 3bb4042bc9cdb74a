"""Quality rules: one threshold table compiled into one Spark projection.

``RULES`` lists ratio, lower and upper limit.  ``measure`` computes the base
counts of every whole text, ``quality_rules`` compiles the table into the
verdict columns.  Everything is a Spark SQL expression of the one row: no
shuffle, no user function.

Defined results for odd input: a null or empty text has no words, all counts
are 0, ``base_failed`` is true and ``kept`` false.  Repeated rows give repeated
results, an empty table an empty result.  Input columns other than the id and
the text never reach the expressions, so their names cannot clash.

Work per row is linear in the text, but for texts that repeat a 5-word window:
those sort their window hashes (64-bit; two different windows of one text that
share a hash would count as repeated, which at a million words per text is
expected once in tens of millions of such texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, let

#: Common function words of the languages covered (fixed values).
STOP_WORDS = (
    "the of and to in that is it for with on by this be at from as was are an a or "
    "der die das und den von zu mit sich des dem ein eine ist im für auf nicht in als "
    "le la les de des du un une et est en que pour dans par sur au plus pas "
    "el los las del y se por con una su para es lo como más o al"
)

#: name, SQL over the measures, lowest and highest accepted value (None: open).
RULES = (
    ("word_count", "CAST(n_words AS DOUBLE)", 10, None),
    ("mean_word_length", "word_chars / greatest(n_words, 1)", 2, 15),
    ("symbol_ratio", "n_symbols / greatest(n_words, 1)", None, 0.2),
    ("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    ("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.3),
    ("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    ("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)

WINDOW = 5


def _repeat_words(h: str) -> str:
    """Words covered by 5-word windows found twice or more; ``h``: word hashes."""
    windows = (f"transform(sequence(0, size({h}) - {WINDOW}), i -> "
               f"xxhash64({', '.join(f'{h}[i + {k}]' for k in range(WINDOW))}))")
    # Sorted (hash, start) pairs: a window is repeated if a neighbour has its hash.
    starts = ("array_sort(transform(filter(transform(s, (p, i) -> struct(p.start AS start, "
              "(i > 0 AND s[i - 1].hash = p.hash) OR (i < size(s) - 1 AND s[i + 1].hash = p.hash) AS twice)), "
              "q -> q.twice), q -> q.start))")
    covered = (f"aggregate(r, struct(0L AS n, -1 AS upto), (a, p) -> struct("
               f"a.n + p + {WINDOW} - greatest(p, a.upto) AS n, p + {WINDOW} AS upto), a -> a.n)")
    slow = let("s", "array_sort(transform(w, (x, i) -> struct(x AS hash, i AS start)))",
               let("r", starts, covered))
    body = f"IF(size(array_distinct(w)) = size(w), 0L, {slow})"
    return f"IF(size({h}) < {WINDOW}, 0L, {let('w', windows, body)})"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and one struct ``m`` of counts per row."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    longest = max(len(w.encode()) for w in STOP_WORDS.split())
    words = f"filter(split(t, '{SPACE}'), x -> x <> '')".replace("\\", "\\\\")
    word_stats = (
        "aggregate(w, struct(0L AS c, 0L AS s), (acc, x) -> struct("
        "acc.c + length(x) AS c, "
        f"acc.s + IF(octet_length(x) <= {longest} AND lower(x) IN ({stop}), 1L, 0L) AS s))")
    lines = "filter(split(t, '\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    line_stats = (
        "struct(CAST(size(l) AS BIGINT) AS n, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS d, "
        "CAST(size(filter(l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS BIGINT) AS e, "
        "CAST(size(filter(l, x -> ltrim(x) rlike '^[-*•‣] ')) AS BIGINT) AS b)")
    per_words = (f"struct(CAST(size(w) AS BIGINT) AS n, {word_stats} AS x, "
                 f"{let('h', 'transform(w, x -> xxhash64(x))', _repeat_words('h'))} AS r)")
    symbols = "CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '')) AS BIGINT)"
    row = f"struct({let('w', words, per_words)} AS w, {let('l', lines, line_stats)} AS l, {symbols} AS sym)"
    m = let("t", f"coalesce(CAST(`{text_col}` AS STRING), '')", row)
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.expr(m).alias("m"))
            .select("doc_id", F.expr(
                "struct(m.w.n AS n_words, m.w.x.c AS word_chars, m.sym AS n_symbols, m.l.d AS n_dup_lines, "
                "m.w.r AS n_repeat_words, m.w.x.s AS n_stop_words, m.l.n AS n_lines, "
                "m.l.e AS n_ellipsis_lines, m.l.b AS n_bullet_lines)").alias("m")))


def failed_rules_sql(rules=RULES) -> str:
    """The threshold table as one SQL array of the names of failed rules."""
    tests = []
    for name, value, low, high in rules:
        bad = [f"{value} {op} {float(limit)!r}D" for op, limit in (("<", low), (">", high)) if limit is not None]
        tests.append(f"IF({' OR '.join(bad)}, '{name}', NULL)")
    return f"array_compact(array({', '.join(tests)}))"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the measures, ``base_failed``, the names of the
    failed rules and ``kept``."""
    flat = measure(docs, id_col, text_col).select("doc_id", "m.*")
    flat = flat.withColumns({
        "base_failed": F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"),
        "failed_rules": F.expr(failed_rules_sql(rules)),
    })
    return flat.withColumn("kept", F.expr("NOT base_failed AND size(failed_rules) = 0"))
