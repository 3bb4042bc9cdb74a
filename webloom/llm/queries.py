"""The thin ``opN_<name>`` queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import (
    ann,
    html_main,
    jaccard_join,
    language_id,
    lexical_search,
    link_filter,
    mixing,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    suffix_dedup,
    token_alignment,
)
from webloom.llm.common import held_out, prepare, table, written

QUERIES = {}
ORACLE = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op6_quality_rules(spark, sf_dir):
    """Counts and verdict of the compiled threshold table for every document."""
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op7_sharding(spark, sf_dir):
    """All documents in 40 shards of near equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_mixing(spark, sf_dir):
    """Words taken from every document by the target mixture of its source."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE["op6_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN (STOP_WORDS))) AS n_stop, len(l) AS n_lines,
         len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ell,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•‣] '))) AS n_bul
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_words < 10 THEN 'word_count' END,
      CASE WHEN word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15
           THEN 'mean_word_length' END,
      CASE WHEN n_symbols / greatest(n_words, 1) > 0.2 THEN 'symbol_ratio' END,
      CASE WHEN n_stop / greatest(n_words, 1) < 0.02 THEN 'stop_word_ratio' END,
      CASE WHEN n_ell / greatest(n_lines, 1) > 0.3 THEN 'ellipsis_line_ratio' END,
      CASE WHEN n_bul / greatest(n_lines, 1) > 0.9 THEN 'bullet_line_ratio' END,
      CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'duplicate_line_ratio' END) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM v
""".replace("STOP_WORDS", ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS.split()))))

ORACLE["op10_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.25::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))
                  / greatest(length(coalesce(text, '')), 1)) AS q
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
fill(k, source, source_size, w, capped) AS (  -- cap, reshare the excess, until none is above
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT k + 1, source, source_size, w, capped OR
         w * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3.0 * source_size ELSE 0.0 END) OVER ())
         / nullif(sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER (), 0) >= 3.0 * source_size
  FROM fill WHERE k < 40),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE
         w * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3.0 * source_size ELSE 0.0 END) OVER ())
         / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () END::DOUBLE AS target
  FROM fill WHERE k = 40),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.epochs,
         round(p.target - p.epochs * p.source_size)::BIGINT
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY
             -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '-') || ':' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE
                  + 0.5) / 4503599627370496.0) / d.q, d.doc_id, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(left_over, size)))::BIGINT AS taken, source
FROM x
"""


@query
def op2_sentencepiece(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"),
                      F.expr("CAST(coalesce(try_element_at(ends, -1), 0) AS BIGINT)").alias("n_bytes_covered"))


@query
def op3_quality_classifier(spark, sf_dir):
    """Quality score of every document, learned outside the held-out fold."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_language_id(spark, sf_dir):
    """Predicted language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op9_nearest_neighbours(spark, sf_dir):
    """Five nearest found of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    """Size and component of every document under the 4-word Jaccard join."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), width=4, threshold=85)


@query
def op5_suffix_dedup(spark, sf_dir):
    """Bytes left of every document without its repeated 200-byte strings."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

ORACLE["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(r, to_r) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.to_r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d t ON t.r = reach.to_r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

ORACLE["op5_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
hit AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY x) > 1),
run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k
        FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, k, min(i) AS b, max(i) + 200 AS e FROM run GROUP BY r, k),
gap AS (SELECT r, e AS a, coalesce(lead(b) OVER (PARTITION BY r ORDER BY b), 1e15::BIGINT) AS z FROM span
        UNION ALL SELECT r, 0, min(b) FROM span GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(h, 2 * a + 1, 2 * (least(z, len(h)) - a)), '' ORDER BY a) AS k
         FROM gap g JOIN d ON d.r = g.r WHERE a < len(h) // 2 GROUP BY g.r),
tot AS (SELECT r, sum(e - b) AS gone, count(*) AS spans FROM span GROUP BY r)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN tot ON tot.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

ORACLE["op7_sharding"] = r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 16 AS size, text IS NULL AS no_text,
             list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16
                            + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM d),
c AS (SELECT doc_id, size, CASE WHEN NOT no_text THEN xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295), 4294967295) END AS text_crc32
      FROM b, tab),
o AS (SELECT *, coalesce(sum(size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
      FROM c WINDOW k AS (ORDER BY text_crc32 NULLS FIRST, doc_id NULLS FIRST, size)),
s AS (SELECT *, least(39, ((2 * before + size) * 40 // (2 * total)))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op12_url_filter(spark, sf_dir):
    """Rule and verdict of every page's URL, by rules or by its host's ranks."""
    return link_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE["op12_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
says AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says
         FROM r),
seed AS (
  SELECT host, CASE WHEN 2 * count(*) FILTER (says = 'allow') > count(*) THEN 'trust'
                    WHEN 2 * count(*) FILTER (says = 'block') > count(*) THEN 'distrust' END AS kind
  FROM says WHERE host <> '' GROUP BY host),
start AS (SELECT kind, host, 1000000000000000 // count(*) OVER (PARTITION BY kind) AS flow FROM seed WHERE kind IS NOT NULL),
link AS (
  SELECT DISTINCT host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script[\x20\x09-\x0D>].*?(?:</script|\z)|<style[\x20\x09-\x0D>].*?(?:</style|\z)|<template[\x20\x09-\x0D>].*?(?:</template|\z)', ' ', 'g'),
    '(?i)<a[\x20\x09-\x0D/](?:[^<>]*?[\x20\x09-\x0D"''/])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?[\x20\x09-\x0D]*(?:https?:)?//([^/?#"''<>\x00-\x20]+)', 1)) AS dst
        FROM p WHERE host <> '')),
pair AS (SELECT * FROM link WHERE src <> dst),
edge AS (
  SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree
  FROM (SELECT 'trust' AS kind, src, dst FROM pair UNION ALL SELECT 'distrust', dst, src FROM pair)),
flow(k, kind, host, flow) AS (
  SELECT 0, kind, host, flow::BIGINT FROM start
  UNION ALL
  SELECT k + 1, kind, host, sum(part)::BIGINT FROM (
    SELECT f.k, f.kind, e.dst AS host, (f.flow * 85 // 100) // e.degree AS part
    FROM flow f JOIN edge e ON e.kind = f.kind AND e.src = f.host WHERE f.k < 40) WHERE part > 0 GROUP BY k, kind, host),
ranked AS (SELECT host, coalesce(sum(flow) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
                  coalesce(sum(flow) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM flow GROUP BY host),
least_of AS (SELECT greatest(1, coalesce(max(flow) FILTER (kind = 'distrust'), 0) * 50 // 100) AS least FROM start)
SELECT page_id, s.host, path, rule,
       coalesce(says, CASE WHEN distrust > trust AND distrust >= least THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM says s LEFT JOIN ranked ON ranked.host = s.host, least_of
"""


@query
def op13_lexical_search(spark, sf_dir):
    """Ten best documents of every benchmark item."""
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE["op13_lexical_search"] = r"""
WITH b AS (
  SELECT DISTINCT item_id, text FROM benchmark),
q AS (
  SELECT item_id, text, t, count(*) AS q FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM b) GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
v AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM v, c GROUP BY t, n_docs),
m AS (SELECT r, doc_id, (100 - 75 + (75::HUGEINT * len(w) * n_docs) // n_terms)::BIGINT AS m FROM d, c WHERE len(w) > 0),
s AS (
  SELECT q.item_id, q.text, m.r, m.doc_id, sum(q.q * f.weight * ((1000000000 * v.tf) // (1000 * v.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN v ON v.t = q.t JOIN f ON f.t = q.t JOIN m ON m.r = v.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@query
def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers over every document."""
    import public_tokenizers

    found = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"), outputs=("groups", "links"))
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "links",
                         F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
    return token_alignment.with_counts(written(found, "align-documents")).drop("row")
