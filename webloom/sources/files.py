"""Readers and writers of the run tables (S2-S7), record unions
and run file names (F21, F22).

* S2 ``scan_ragged_csv`` — append-only CSV whose header is older/shorter
  than later rows, each file in the order of its own header: missing trailing
  columns come back NULL (without a schema Spark silently drops the extras).
* S3 ``scan_flat_json`` — one JSON array of heterogeneous records, split by
  ``record_type`` (NULL = page).
* S4 ``scan_run_logs`` — ``ts - logger - level - message`` lines.
* S5 ``write_run_tables`` — one folder per table, partitioned by host and
  run timestamp (partition pruning on read).
* S6 ``append_master`` — append a run to a master table, schema aligned to
  the newest columns.
* S7 ``write_flat_json`` — page, link and heading rows as JSON Lines.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.core import expr
from ..functions.urls import url_split_sql, netloc_host_sql

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("scraped_at", T.StringType()),
    T.StructField("text_length", T.IntegerType()), T.StructField("paragraph_count", T.IntegerType()),
    T.StructField("heading_count", T.IntegerType()), T.StructField("image_count", T.IntegerType()),
    T.StructField("form_count", T.IntegerType()), T.StructField("http_status_code", T.IntegerType()),
    T.StructField("response_time_ms", T.IntegerType()),
])
LINKS_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("link_number", T.IntegerType()),
    T.StructField("link_url", T.StringType()), T.StructField("link_text", T.StringType()),
    T.StructField("link_title", T.StringType()), T.StructField("is_external", T.BooleanType()),
    T.StructField("scraped_at", T.StringType()),
])
IMAGES_SCHEMA = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("page_id", T.StringType()),
    T.StructField("image_src", T.StringType()), T.StructField("image_alt", T.StringType()),
    T.StructField("is_external", T.BooleanType()), T.StructField("scraped_at", T.StringType()),
])
SCHEMAS = {"pages": PAGES_SCHEMA, "links": LINKS_SCHEMA, "images": IMAGES_SCHEMA}


def _headers(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Files by their first line."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start",
                                          F.monotonically_increasing_id().alias("at")).filter("file_block_start = 0")
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    return {r.header: [unquote(p) for p in r.files] for r in
            first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()}


def scan_ragged_csv(spark: SparkSession, paths, table: str, header: bool = True) -> DataFrame:
    """CSV with a header older than some rows; trailing columns missing
    from older rows read as NULL.  Booleans are written ``True``/``False``.

    Files are grouped by their header and each group is read in the order of
    its own columns: columns that the header lacks follow it in the order of the
    newest schema, as later rows were appended, and columns that the table does
    not know are left.  Without headers the newest schema gives the order."""
    schema = SCHEMAS[table]

    def read(files, columns: T.StructType) -> DataFrame:
        return (spark.read.schema(columns).option("header", header).option("enforceSchema", True)
                .option("multiLine", False).option("escape", "\"").csv(files)).select(*schema.fieldNames())

    if not header:
        return read(paths, schema)
    known, groups = {f.name: f for f in schema.fields}, []
    for line, files in sorted(_headers(spark, paths).items()):
        names = next(csv.reader([line.lstrip("\ufeff")]), [])
        columns = [known.get(n, T.StructField(n or f"_c{i}", T.StringType())) for i, n in enumerate(names)]
        groups.append(read(files, T.StructType(columns + [f for f in schema.fields if f.name not in names])))
    return union_runs(groups) if groups else spark.createDataFrame([], schema)


#: The columns of a flat record; absent keys read as NULL.
FLAT_PAGE = ["url", "title", "description", "scraped_at", "scraping_method", "text_content", "paragraphs_count",
             "headings_count", "links_count", "images_count", "forms_count"]
FLAT_LINK = ["url", "link_number", "link_url", "link_text", "link_title", "is_external"]
FLAT_HEADING = ["url", "heading_number", "heading_level", "heading_text"]
_FLAT_TYPES = {"is_external": "boolean"} | {c: "long" for c in (
    "paragraphs_count", "headings_count", "links_count", "images_count", "forms_count", "link_number",
    "heading_number", "heading_level")}
FLAT_SCHEMA = ", ".join(f"{c} {_FLAT_TYPES.get(c, 'string')}"
                        for c in dict.fromkeys(["record_type", *FLAT_PAGE, *FLAT_LINK, *FLAT_HEADING]))


def scan_flat_json(spark: SparkSession, paths, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: (pages, links, headings) from heterogeneous records: JSON arrays,
    or JSON lines with ``multi_line=False``.  The schema is given, so the
    columns do not vary with the data."""
    df = spark.read.schema(FLAT_SCHEMA).option("multiLine", multi_line).json(paths)
    return (df.filter(F.col("record_type").isNull()).select(*FLAT_PAGE),
            df.filter(F.col("record_type") == "link").select(*FLAT_LINK),
            df.filter(F.col("record_type") == "heading").select(*FLAT_HEADING))


def number_lines(spark: SparkSession, paths) -> DataFrame:
    """value, file and line_no (from 1) of text files.  Lines are numbered
    within their split of the file, whose first number is the sum of the lines of
    the splits before it: a large file is numbered by many tasks, and only counts
    meet in one."""
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_split"),
                                          F.monotonically_increasing_id().alias("_at"))
    counts = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("file").alias("_f"), F.col("_split").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at"))
    numbered = lines.withColumn("_no", within).join(starts, (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    return numbered.select("value", "file", (F.col("_before") + F.col("_no")).alias("line_no"))


def scan_run_logs(spark: SparkSession, paths) -> DataFrame:
    """Parsed run-log lines with their file and line number."""
    from ..operators.runs import parse_run_logs
    return parse_run_logs(number_lines(spark, paths))


def run_file_name_sql(table: str, host: str, ts: str) -> str:
    """``{table}_{host}_{yyyyMMdd_HHmmss}`` (session time zone)."""
    return f"concat_ws('_', {table}, {host}, date_format({ts}, 'yyyyMMdd_HHmmss'))"


def parse_run_file_name_sql(name: str, part: int = 2) -> str:
    """the n-th '_'-separated part of a run file name (2 = host)."""
    return f"element_at(split(regexp_replace({name}, '\\\\.[a-z]+$', ''), '_'), {part})"


def write_run_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """Each table partitioned by host and run time, so a reader of one
    host or run prunes the rest.  Every table needs ``url`` (the page's; carry
    it on links and images), which only the pages table keeps.

    Rows are rebalanced by host and run: by the sizes that the shuffle has
    measured, a host that is large is written by as many tasks as it has
    advisory sizes, and a small host by one (a few where it shares the shuffle
    partition of a large one).  The partitions of a run are overwritten, so a
    repeated write changes nothing."""
    for name, df in tables.items():
        if "url" not in df.columns:
            raise ValueError(f"the table {name} has no page url to take its host from")
        host = expr(netloc_host_sql(f"{url_split_sql('url')}.netloc"))
        part = df.withColumn("host", F.coalesce(host, F.lit("unknown"))) \
            .withColumn("run_ts", F.date_format("scraped_at", "yyyyMMdd_HHmmss"))
        part = part if name == "pages" else part.drop("url")
        part.hint("rebalance", "host", "run_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("host", "run_ts").format(fmt).save(f"{out_dir}/{name}")


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Bag union of run tables with older/newer schemas (no dedup)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def append_master(df: DataFrame, path: str, table: str, run: str, fmt: str = "parquet") -> None:
    """Add a run to the master table, aligned to the newest schema (times
    as ISO text with their zone).  A run is one partition, which a retry
    overwrites."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c, t in df.dtypes if t == "timestamp"}
    aligned = df.withColumns(iso).select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])
    aligned.write.mode("overwrite").format(fmt).save(f"{path}/run={run}")


def read_master(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all runs of a master table, with the run they came from."""
    schema = T.StructType([*SCHEMAS[table].fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).format(fmt).load(path)


def flatten_records(rec: DataFrame) -> DataFrame:
    """D3: page, link and heading rows of processed records as one
    heterogeneous set keyed by url (``record_type`` NULL for page rows): the
    rows are built as arrays of the page's own row and exploded once."""
    types = {"record_type": "string", **{c: _FLAT_TYPES.get(c, "string") for c in [*FLAT_PAGE, *FLAT_LINK, *FLAT_HEADING]}}
    fields = [f.split(" ")[0] for f in FLAT_SCHEMA.split(", ")]

    def row(**given: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', CAST({given.get(f, 'NULL')} AS {types[f]})" for f in fields) + ")"

    page = row(url="url", title="coalesce(metadata.title, '')", description="metadata.description",
               scraped_at="date_format(scraped_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
               scraping_method="scraping_method" if "scraping_method" in rec.columns else "'static'",
               text_content="coalesce(content.text, '')", paragraphs_count="size(coalesce(content.paragraphs, array()))",
               headings_count="size(coalesce(content.headings, array()))", links_count="size(links)",
               images_count="size(images)", forms_count="size(coalesce(forms, array()))")
    link = row(record_type="'link'", url="url", link_number="i + 1", link_url="l.link_url", link_text="l.link_text",
               link_title="l.link_title", is_external="l.is_external")
    heading = row(record_type="'heading'", url="url", heading_number="i + 1", heading_level="h.level", heading_text="h.text")
    rows = (f"concat(array({page}), transform(link_rows, (l, i) -> {link}), "
            f"transform(coalesce(content.headings, array()), (h, i) -> {heading}))")
    return rec.filter("valid").select(F.explode_outer(expr(rows)).alias("r")).select("r.*")     # never empty


def write_flat_json(rec: DataFrame, path: str) -> None:
    """The flat records as JSON Lines."""
    flatten_records(rec).write.mode("overwrite").json(path)
