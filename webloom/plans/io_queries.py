"""Queries that write and read again (sources and sinks), and those on times
and ids.  What is written goes to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs as RN
from ..session import staged
from ..operators.process import assign_page_id_sql, links_table, normalize_scraped_at_sql, pages_table, process_records
from ..operators.extract import extract_raw
from ..session import checkpoint_path
from ..sources import files as S
from . import derived as DV
from .rich import rich_pages

RUN_TS = "2026-01-01 00:00:00"
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql.strip()
        return fn
    return deco


def _path(spark, name: str) -> str:
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _records(spark, sf) -> DataFrame:
    return process_records(extract_raw(rich_pages(spark, sf)), RUN_TS)


_HOST = "'h' || (page_id % 7) || '.example'"


@query("write_run_tables", f"""
SELECT 'pages' AS tab, {_HOST} AS host, '20260101_000000' AS run_ts, count(*) AS n FROM pages GROUP BY page_id % 7
UNION ALL SELECT 'links', {_HOST}, '20260101_000000', 3 * count(*) FROM pages GROUP BY page_id % 7
""".replace("GROUP BY page_id % 7", "GROUP BY ALL"))
def q_write_run_tables(spark, sf):
    """Pages and links written by host and run (twice: a retry changes
    nothing), read back."""
    rec, out = _records(spark, sf), _path(spark, "run-tables")
    for _ in range(2):
        S.write_run_tables({"pages": pages_table(rec), "links": links_table(rec, ("url",))}, out)
    back = [spark.read.parquet(f"{out}/{t}").groupBy("host", "run_ts").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(t).alias("tab"), "host", F.col("run_ts").cast("string").alias("run_ts"), "n") for t in ("pages", "links")]
    return back[0].unionByName(back[1])


@query("append_master", """
SELECT CAST(page_id AS VARCHAR) AS page_id, run, '2026-01-01T00:00:00.000000Z' AS scraped_at,
       CASE run WHEN 'r2' THEN 200::BIGINT END AS http_status_code FROM pages, (VALUES ('r1'), ('r2')) v(run)
""")
def q_append_master(spark, sf):
    """An old-schema and a new-schema run in one master table; the second
    run is added twice."""
    pages, out = pages_table(_records(spark, sf)), _path(spark, "master")
    S.append_master(pages.drop("http_status_code", "response_time_ms"), out, "pages", "r1")
    for _ in range(2):
        S.append_master(pages, out, "pages", "r2")
    return S.read_master(spark, out, "pages").select("page_id", "run", "scraped_at", F.col("http_status_code").cast("long").alias("http_status_code"))


@query("scan_ragged_csv", """
SELECT CAST(page_id AS VARCHAR) AS page_id, 'T, "q" ' || page_id AS title, 9::BIGINT AS text_length,
       CASE WHEN page_id % 2 = 1 THEN 200::BIGINT END AS http_status_code FROM pages
""")
def q_scan_ragged_csv(spark, sf):
    """CSV lines of an older, shorter and of the newer layout in one
    folder, quoted commas and quotes included."""
    pages, out = spark.read.parquet(f"{sf}/pages.parquet"), _path(spark, "ragged")
    line = F.concat_ws(",", F.col("page_id").cast("string"), F.lit("https://x/"),
                       F.concat(F.lit('"T, ""q"" '), F.col("page_id").cast("string"), F.lit('"')),
                       F.lit("2026-02-15T15:04:10+00:00,9,1,1,0,0"), F.when(F.col("page_id") % 2 == 1, F.lit("200,33")))
    pages.select(line.alias("value")).write.text(out)
    return S.scan_ragged_csv(spark, out, "pages", header=False).select("page_id", "title", F.col("text_length").cast("long").alias("text_length"),
        F.col("http_status_code").cast("long").alias("http_status_code"))


@query("scan_csv_by_header", """
SELECT CAST(page_id AS VARCHAR) AS page_id, 'http://h/' || page_id AS url, 't' || page_id AS title, page_id % 50 AS text_length,
       CASE page_id % 3 WHEN 1 THEN 404::BIGINT WHEN 2 THEN 200 END AS http_status_code FROM pages
""")
def q_scan_csv_by_header(spark, sf):
    """Files whose headers differ in order and length, and one with a column
    that the table does not know, read in one go."""
    pages, out = spark.read.parquet(f"{sf}/pages.parquet"), _path(spark, "by-header")
    pid, url, title, size = "CAST(page_id AS STRING) AS page_id", "concat('http://h/', page_id) AS url", "concat('t', page_id) AS title", "page_id % 50 AS text_length"
    pages.filter("page_id % 3 = 0").selectExpr(pid, url, title, size).write.option("header", True).csv(f"{out}/0")
    pages.filter("page_id % 3 = 1").selectExpr("404 AS http_status_code", size, title, pid, url).write.option("header", True).csv(f"{out}/1")
    pages.filter("page_id % 3 = 2").selectExpr(url, "'x' AS note", pid, "200 AS http_status_code", title, size).write.option("header", True).csv(f"{out}/2")
    rows = S.scan_ragged_csv(spark, [f"{out}/{k}" for k in range(3)], "pages")
    return rows.select("page_id", "url", "title", *[F.col(c).cast("long").alias(c) for c in ("text_length", "http_status_code")])


@query("run_log_line_numbers", """
SELECT row_number() OVER (ORDER BY line_no) AS line_no, value FROM (
  SELECT event_id * 2 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' start ' || event_id AS value FROM events
  UNION ALL SELECT event_id * 2 + 1, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' end ' || event_id FROM events)
""")
def q_run_log_line_numbers(spark, sf):
    """Lines of one file, which is read in many splits, by their number."""
    ev, out = spark.read.parquet(f"{sf}/events.parquet"), _path(spark, "long-log")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    lines = ev.select((F.col("event_id") * 2).alias("n"), F.concat(stamp, F.lit(" start "), F.col("event_id").cast("string")).alias("value")) \
        .unionByName(ev.select((F.col("event_id") * 2 + 1).alias("n"), F.concat(stamp, F.lit(" end "), F.col("event_id").cast("string")).alias("value")))
    lines.orderBy("n").coalesce(1).select("value").write.text(out)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        numbered = staged(S.number_lines(spark, out), "numbered-lines")
    finally:
        spark.conf.set(key, was)
    return numbered.select("line_no", "value")


@query("scan_flat_json", f"""
SELECT 'page' AS kind, 'https://' || {_HOST} || '/d/p' || page_id AS url, 'T & ' || page_id AS what, 3::BIGINT AS n FROM pages
UNION ALL SELECT 'link', 'https://' || {_HOST} || '/d/p' || page_id, CASE k WHEN 1 THEN 'link one' WHEN 2 THEN 'ext' ELSE 'frag' END, k FROM pages, (VALUES (1::BIGINT), (2), (3)) v(k)
UNION ALL SELECT 'heading', 'https://' || {_HOST} || '/d/p' || page_id, CASE k WHEN 1 THEN 'Two ' || page_id WHEN 2 THEN 'One' WHEN 3 THEN 'Three' ELSE 'Six' END, k
          FROM pages, (VALUES (1::BIGINT), (2), (3), (4)) v(k)
""")
def q_scan_flat_json(spark, sf):
    """S7 then S3: flat records written as JSON lines, read and split by type."""
    out = _path(spark, "flat-json")
    S.write_flat_json(_records(spark, sf), out)
    pages, links, headings = S.scan_flat_json(spark, out, multi_line=False)
    return (pages.select(F.lit("page").alias("kind"), "url", F.col("title").alias("what"), F.col("links_count").alias("n"))
            .unionByName(links.select(F.lit("link").alias("kind"), "url", F.col("link_text").alias("what"), F.col("link_number").alias("n")))
            .unionByName(headings.select(F.lit("heading").alias("kind"), "url", F.col("heading_text").alias("what"), F.col("heading_number").alias("n"))))


@query("scan_run_logs", """
SELECT 'https://u' || CAST(user_id AS VARCHAR) || '.example/' AS url, count(*) AS starts,
       count(*) FILTER (WHERE event_type <> 'error') AS finishes, count(*) AS sessions FROM events GROUP BY 1
""")
def q_scan_run_logs(spark, sf):
    """Log lines written as text files and parsed again."""
    out = _path(spark, "run-logs")
    DV.run_log_lines(spark, sf).select("value").write.text(out)
    logs = S.scan_run_logs(spark, out)
    start = F.col("message").startswith(RN.START_PREFIX)
    return logs.groupBy("url").agg(F.count_if(start).alias("starts"), F.count_if(~start).alias("finishes"),
                                   F.count("session_id").alias("sessions"))


@query("normalize_scraped_at", """
SELECT CAST(page_id AS VARCHAR) AS page_id,
  CASE page_id % 4 WHEN 0 THEN '2025-05-05 10:11:12.000000' WHEN 1 THEN '2025-05-05 10:11:12.500000' ELSE '2026-01-01 00:00:00.000000' END AS from_text,
  CASE page_id % 4 WHEN 3 THEN '2026-01-01 00:00:00.000000' ELSE '2025-05-05 10:11:12.' || CASE page_id % 4 WHEN 1 THEN '500000' ELSE '000000' END END AS from_time
FROM pages
""")
def q_normalize_scraped_at(spark, sf):
    """ISO texts (short ones and NULL take the run time) and timestamps
    (whole seconds are kept)."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").cast("string").alias("page_id"),
        F.expr("CASE page_id % 4 WHEN 0 THEN '2025-05-05T10:11:12+00:00' WHEN 1 THEN '2025-05-05T10:11:12.5+00:00' WHEN 2 THEN '2025-05-05' END").alias("s"),
        F.expr("CASE page_id % 4 WHEN 1 THEN TIMESTAMP'2025-05-05 10:11:12.5' WHEN 3 THEN NULL ELSE TIMESTAMP'2025-05-05 10:11:12' END").alias("t"))
    show = lambda sql: F.date_format(F.expr(sql), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return pages.select("page_id", show(normalize_scraped_at_sql("s", RUN_TS)).alias("from_text"),
                        show(normalize_scraped_at_sql("t", RUN_TS, is_text=False)).alias("from_time"))


@query("assign_page_id", """
SELECT page_id AS n, CASE WHEN page_id % 3 = 0 THEN 's' || page_id ELSE sha256(url || '#2026-01-01 00:00:00') END AS page_id FROM pages
""")
def q_assign_page_id(spark, sf):
    """the session id, else a name made of url and time."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sid = "CASE WHEN page_id % 3 = 0 THEN concat('s', page_id) END"
    return pages.select(F.col("page_id").alias("n"), F.expr(assign_page_id_sql(sid, "url", f"TIMESTAMP'{RUN_TS}'")).alias("page_id"))


@query("latest_snapshot_by_url", """
SELECT DISTINCT 'https://h' || (page_id % 9) || '.example/' AS url,
  CAST(max(CASE WHEN page_id % 4 <> 3 THEN page_id - page_id % 2 END) OVER (PARTITION BY page_id % 9) AS VARCHAR) AS hour,
  arg_min(CAST(page_id AS VARCHAR), CAST(page_id AS VARCHAR)) FILTER (WHERE keep) OVER (PARTITION BY page_id % 9) AS page_id
FROM (SELECT page_id, page_id % 4 <> 3 AND page_id - page_id % 2 = max(CASE WHEN page_id % 4 <> 3 THEN page_id - page_id % 2 END) OVER (PARTITION BY page_id % 9) AS keep FROM pages)
""")
def q_latest_by_url(spark, sf):
    """Newest of many snapshots per url; ties go to the smallest page id
    and snapshots without a time are older than any."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").cast("string").alias("page_id"), F.expr("concat('https://h', page_id % 9, '.example/')").alias("url"),
        F.expr("CASE WHEN page_id % 4 <> 3 THEN timestamp_seconds((page_id - page_id % 2) * 3600) END").alias("scraped_at"))
    best = RN.latest_snapshot(pages, key="url")
    return best.select("url", F.expr("CAST(unix_seconds(scraped_at) DIV 3600 AS STRING)").alias("hour"), "page_id")
