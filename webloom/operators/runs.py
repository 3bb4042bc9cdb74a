"""Run and host analytics: A4, A7, W4-W6, T1, T2 and session state (X2,
X3, P17) in batch form.

Scale notes: roll-ups use partial (map-side) aggregation, so a host that
holds a third of all pages is pre-aggregated in every task before the
shuffle.  "Latest per key" is an aggregate over narrow columns (not a ranking
window) for the same reason.  The politeness gap (W5) is computed inside
(host, hour) buckets and stitched across bucket edges with a small
per-bucket aggregate, so a hot host is spread over many tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import expr
from ..functions.text import truncate_sql
from ..functions.urls import url_split_sql
from ..session import staged

# Session statuses that end a session.
FINISHED_STATES = ["completed", "error", "stopped"]
# Run-log messages.
START_PREFIX = "Starting scraping session "
FINISH_PREFIX = "Successfully scraped "


def host_rollup(rec: DataFrame) -> DataFrame:
    """A4: pages, links, external links and mean response time per host, plus
    a grand-total row (host NULL) via ``rollup``, straight from the processed
    records: link rows are counted in their arrays, nothing is joined."""
    time = F.col("response_time_ms") if "response_time_ms" in rec.columns else F.lit(0)
    p = rec.filter("valid").select(
        expr(f"{url_split_sql('url')}.netloc").alias("host"), time.alias("ms"), F.size("link_rows").alias("n_links"),
        F.size(F.filter("link_rows", lambda l: l["is_external"])).alias("n_external"))
    return p.rollup("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n_links").cast("long").alias("links"),
        F.sum("n_external").cast("long").alias("external_links"),
        F.avg("ms").alias("avg_response_ms"))


def gate_outcomes(outcomes: DataFrame) -> DataFrame:
    """Pages per (status, error) and the share of all pages."""
    counts = outcomes.groupBy("status", "error").agg(F.count(F.lit(1)).alias("pages"))
    total = Window.partitionBy()
    return counts.withColumn("share", F.col("pages") / F.sum("pages").over(total))


def parse_run_logs(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``yyyy-MM-dd HH:mm:ss,SSS - logger - level - message`` lines into
    columns, with session id and URL taken from the manager's messages."""
    pat = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - (\S+) - (.*)$"
    return lines.select(
        F.to_timestamp(F.regexp_extract(text_col, pat, 1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"),
        F.regexp_extract(text_col, pat, 2).alias("logger"),
        F.regexp_extract(text_col, pat, 3).alias("level"),
        F.regexp_extract(text_col, pat, 4).alias("message"),
        *[c for c in lines.columns if c != text_col],
    ).withColumn("session_id", F.nullif(F.regexp_extract("message", r"^Starting scraping session (\S+) for ", 1), F.lit(""))) \
     .withColumn("url", F.coalesce(F.nullif(F.regexp_extract("message", r"^Starting scraping session \S+ for (.*)$", 1), F.lit("")),
                                   F.nullif(F.regexp_extract("message", r"^Successfully scraped (.*)$", 1), F.lit(""))))


def session_durations(logs: DataFrame, bucket_sec: int = 3600) -> DataFrame:
    """Start → next finish of the same URL; a start followed by another
    start (or nothing) is a failed run.  The next line is looked up within
    (url, time bucket); the last line of a bucket takes the first line of the
    URL's next bucket (one row per url and bucket), so a URL that holds much
    of the log is spread over many tasks."""
    ev = logs.filter(F.col("message").startswith(START_PREFIX) | F.col("message").startswith(FINISH_PREFIX)) \
        .withColumn("is_start", F.col("message").startswith(START_PREFIX)) \
        .withColumn("_bucket", F.floor(F.unix_micros("ts") / (bucket_sec * 1_000_000)).cast("long"))
    w = Window.partitionBy("url", "_bucket").orderBy("ts", "line_no")
    firsts = ev.groupBy("url", "_bucket").agg(F.min(F.struct("ts", "line_no", "is_start")).alias("_first"))
    wb = Window.partitionBy("url").orderBy("_bucket")
    edges = firsts.select("url", "_bucket", F.lead("_first").over(wb).alias("_edge"))
    nxt = ev.withColumn("_ts", F.lead("ts").over(w)).withColumn("_start", F.lead("is_start").over(w)) \
        .join(edges, ["url", "_bucket"], "left") \
        .withColumn("next_ts", F.coalesce("_ts", "_edge.ts")) \
        .withColumn("next_is_start", F.coalesce("_start", "_edge.is_start"))
    ok = F.col("next_ts").isNotNull() & ~F.col("next_is_start")
    return nxt.filter("is_start").select(
        "session_id", "url", F.col("ts").alias("started_at"),
        F.when(ok, F.col("next_ts")).alias("finished_at"),
        F.when(ok, (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6).alias("duration_sec"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("outcome"))


def politeness_audit(requests: DataFrame, min_gap_sec: float = 1.0, bucket_sec: int = 3600) -> DataFrame:
    """Gap to the previous request on the same host; ``too_fast`` when
    below the required delay.  Skew-safe lag: lag inside (host, bucket),
    bucket edges take the last request time of the nearest earlier bucket
    (from a per-bucket max, one row per host-bucket)."""
    b = F.floor(F.unix_micros("ts") / (bucket_sec * 1_000_000)).cast("long")
    r = requests.withColumn("_bucket", b)
    w = Window.partitionBy("host", "_bucket").orderBy("ts", "request_id")
    inner = r.withColumn("_prev", F.lag("ts").over(w))
    last_per_bucket = r.groupBy("host", "_bucket").agg(F.max("ts").alias("_last"))
    wb = Window.partitionBy("host").orderBy("_bucket")
    edges = last_per_bucket.withColumn("_edge_prev", F.lag("_last").over(wb)).select("host", "_bucket", "_edge_prev")
    out = inner.join(edges, ["host", "_bucket"], "left") \
        .withColumn("prev_ts", F.coalesce("_prev", "_edge_prev"))
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    return out.select(*requests.columns, "prev_ts", gap.alias("gap_sec"),
                      F.coalesce(gap < F.lit(min_gap_sec), F.lit(False)).alias("too_fast"))


#: Winners whose places are broadcast to the second read; more are joined.
PLACES_AT_HAND = 1_000_000


def row_place(df: DataFrame) -> Column:
    """Where a row lies: file and index for rows read from Parquet files, else
    its number within the input's partitions (the same in every run of the same
    scan)."""
    try:
        df.select("_metadata.row_index").schema
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def latest_snapshot(pages: DataFrame, key: str = "url") -> DataFrame:
    """The newest row per key (ties: smallest page_id, NULL last, then the
    row that comes first; a NULL time is older than any): exactly one row for
    each key, the NULL key included.

    One aggregate over key, time, id and place, pre-combined in every task,
    finds the winner's place; the input is then read again for the winners only.
    Their places are broadcast up to PLACES_AT_HAND (counted first), so wide
    columns are not shuffled; beyond, the second read is joined by place."""
    kind = pages.schema["scraped_at"].dataType.typeName()
    time = F.col("scraped_at") if kind in ("long", "integer", "double") else F.unix_micros(F.col("scraped_at").cast("timestamp"))
    newest = F.coalesce(-time, F.lit((1 << 63) - 1))
    placed = pages.select("*", row_place(pages).alias("_place"))
    order = F.struct(newest.alias("t"), F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("_place").alias("place"))
    best = placed.groupBy(key).agg(F.min(order).alias("_best")).select(F.col("_best.place").alias("_winner"))
    best = staged(best, "latest-places")
    best = F.broadcast(best) if best.count() <= PLACES_AT_HAND else best
    return placed.join(best, F.col("_place") == F.col("_winner"), "left_semi").drop("_place")


def recent_runs(pages: DataFrame, k: int = 5) -> DataFrame:
    """The k newest runs (top-k, TakeOrderedAndProject)."""
    return pages.orderBy(F.desc("scraped_at"), F.asc("page_id")).limit(k)


def first_record(pages: DataFrame) -> DataFrame:
    """T2, first half: the raw row of the first page id, before any parse."""
    return pages.orderBy(F.col("page_id").cast("string")).limit(1)


def first_record_preview(records: DataFrame, text_col: str, n: int = 500) -> DataFrame:
    """The first record with the first n characters of its text."""
    return records.orderBy("page_id").limit(1).select("page_id", expr(truncate_sql(text_col, n)).alias("preview"))


# What a session shows before its first event.
INITIAL_PROGRESS, INITIAL_STEP, INITIAL_STATUS = 0, "Initializing", "running"


def session_state(events: DataFrame, started: DataFrame | None = None) -> DataFrame:
    """X2 (batch): latest (progress, step, status) per session, tie-break
    by sequence; an aggregate, so hot sessions pre-aggregate per task.
    ``started(session_id)``: sessions to list even before their first event,
    at progress 0 and step ``Initializing``."""
    last = F.max_by(F.struct("progress", "step", "status"), F.struct("ts", "seq"))
    state = events.groupBy("session_id").agg(last.alias("s"), F.max("ts").alias("updated_at")) \
        .select("session_id", "s.progress", "s.step", "s.status", "updated_at")
    if started is None:
        return state
    return started.select("session_id").distinct().join(state, "session_id", "full").select(
        "session_id",
        F.coalesce("progress", F.lit(INITIAL_PROGRESS)).alias("progress"),
        F.coalesce("step", F.lit(INITIAL_STEP)).alias("step"),
        F.coalesce("status", F.lit(INITIAL_STATUS)).alias("status"), "updated_at")


def active_sessions(state: DataFrame) -> DataFrame:
    """Sessions not completed, errored or stopped."""
    return state.filter(~F.col("status").isin(*FINISHED_STATES))


def stop_sessions(state: DataFrame, stops: DataFrame) -> DataFrame:
    """X3 (batch): a stop request ends an active session; unknown ids are
    ignored (the result lists the sessions that get stopped)."""
    return active_sessions(state).join(stops.select("session_id").distinct(), "session_id", "left_semi") \
        .withColumn("status", F.lit("stopped"))
