"""S1 — scan a table of fetched pages.

The input is one page per row: ``page_id, url, html`` plus optional fetch
metadata (``http_status_code``, ``response_time_ms``, ``headers`` map,
``scraped_at``).  Parquet is the default; json/csv/text readers accept the
same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ["page_id", "url", "html"]
OPTIONAL_COLUMNS = ["http_status_code", "response_time_ms", "headers", "scraped_at",
                    "scraping_method", "user_agent", "content_language"]


#: A task of a spread scan gets this much markup at most (a larger page is
#: alone), and so does an Arrow batch of its Python, whatever the session's rows to
#: a batch; a small input is still cut into this many bytes at least.
TASK_BYTES, LEAST_BYTES = 8 << 20, 64 << 10
#: Ranges of page keys whose bytes are summed, and as many for large pages.
RANGES = 8192


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet", task_bytes: int | None = None) -> DataFrame:
    """Read pages and keep only the page columns (so the scan is pruned).

    The scan's splits follow row groups and files, not work: one row group is
    one split, and pages differ in size.  ``task_bytes`` asks for tasks of equal
    bytes instead (``spread_by_bytes``)."""
    df = spark.read.format(fmt).load(path)
    columns = [c for c in PAGE_COLUMNS + OPTIONAL_COLUMNS if c in df.columns]
    if task_bytes is None:
        return df.select(*columns)
    if fmt == "parquet":                                             # the row's place, the same in every run
        place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    else:
        place = F.xxhash64(F.monotonically_increasing_id())
    return spread_by_bytes(df.select(*columns, place.alias("_place")), task_bytes, key_col="_place").drop("_place")


def spread_by_bytes(pages: DataFrame, task_bytes: int = TASK_BYTES, html_col: str = "html",
                    key_col: str | None = None) -> DataFrame:
    """The same rows in tasks of about equal bytes of markup.

    Page keys are cut into RANGES hash ranges, whose bytes one aggregate sums
    (pages over half a task go to ranges of their own); prefix sums over the
    ranges cut them into tasks.  ``key_col`` tells rows apart; without it their
    place in the input does, so no repeated page or host is one task.  The pages
    are read twice and shuffled once: for inputs of few row groups or very
    unequal pages."""
    spark = pages.sparkSession
    key = F.col(key_col) if key_col else F.xxhash64(F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length(F.col(html_col)), F.lit(0)).cast("long") + 64
    keyed = pages.withColumns({"_size": size, "_range": F.pmod(key, F.lit(RANGES)).cast("int")})
    keyed = keyed.withColumn("_range", F.col("_range") + F.when(F.col("_size") > task_bytes // 2, RANGES).otherwise(0))
    sums = sorted(map(tuple, keyed.groupBy("_range").agg(F.sum("_size")).collect()))     # 2 * RANGES rows at most
    if not sums:
        return pages
    total, cores = sum(n for _, n in sums), spark.sparkContext.defaultParallelism
    share = max(1, min(task_bytes, max(LEAST_BYTES, total // (2 * cores))))
    tasks, place, filled = 0, [], 0
    for r, n in sums:
        if filled and (filled + n > share or r >= RANGES):
            tasks, filled = tasks + 1, 0
        place.append((r, tasks))
        filled += n
    to = spark.createDataFrame(place, "_range int, _task int")
    dealt = keyed.join(F.broadcast(to), "_range").repartitionById(tasks + 1, F.col("_task"))
    return dealt.select(*pages.columns)


def with_fetch_defaults(pages: DataFrame) -> DataFrame:
    """Add absent fetch columns so every stage sees one schema: status 200 and
    time 0 where the key is missing, else NULL."""
    absent = {"http_status_code": F.lit(200), "response_time_ms": F.lit(0), "scraped_at": F.lit(None).cast("timestamp"),
              "headers": F.lit(None).cast("map<string,string>"), "scraping_method": F.lit(None).cast("string")}
    return pages.withColumns({c: v for c, v in absent.items() if c not in pages.columns})
