"""J4 page by page and on bucketed tables; W6 with rows that are equal."""
import re

from pyspark.sql import functions as F

from webloom.operators.extract import extract_raw
from webloom.operators.process import (images_table, links_table, page_children, page_children_local, pages_table, process_records,
                                       write_bucketed)
from webloom.operators.runs import latest_snapshot
from webloom.plans.rich import rich_pages
from webloom.session import checkpoint_path, staged

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records(spark):
    more = spark.createDataFrame([(900, "https://h/", "<p>no children here</p>"), (901, "", "<a href='http://x/'>a</a>")],
                                 "page_id long, url string, html string")
    return process_records(extract_raw(staged(rich_pages(spark, SF), "test-pages").unionByName(more)), "2026-01-01 00:00:00")


def test_page_local_children_equal_the_join(spark):
    rec = records(spark)
    kept = staged(rec, "test-records")
    for child, table in (("links", links_table), ("images", images_table)):
        local = page_children_local(rec, child)
        want = page_children(pages_table(kept), table(kept)).select(*local.columns)
        assert sorted(map(str, local.collect())) == sorted(map(str, want.collect()))
        plan = plan_of(local)
        assert len(re.findall(r"\bMapInArrow", plan)) <= 2 and "Exchange" not in plan     # one for each side of the union


def test_bucketed_tables_join_in_place(spark):
    rec = staged(records(spark), "test-bucketed")
    tables = write_bucketed({"pages": pages_table(rec), "links": links_table(rec)}, "test_j4", checkpoint_path(spark, "test-j4"), 4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = page_children(tables["pages"], tables["links"])
        assert "Exchange" not in plan_of(joined).replace("AQEShuffleRead", "")
        want = page_children(pages_table(rec), links_table(rec)).select(*joined.columns)
        assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql("DROP TABLE test_j4_pages")
        spark.sql("DROP TABLE test_j4_links")


def test_latest_snapshot_gives_one_row_per_key(spark, tmp_path):
    rows = [("p1", "u", 5, "a"), ("p1", "u", 5, "a"), ("p2", "u", 5, "b"), ("p0", "u", 4, "c"), ("p9", "v", None, "d"), ("p8", "v", None, "d"),
            (None, "w", 1, "e"), ("p3", "w", 1, "f"), ("p4", None, 2, "g"), ("p4", None, 2, "g"), ("p5", None, 1, "h")]
    df = spark.createDataFrame(rows, "page_id string, url string, at long, html string") \
        .select("page_id", "url", F.timestamp_seconds("at").alias("scraped_at"), "html").repartition(3)
    df.write.parquet(f"{tmp_path}/runs")
    stored = spark.read.parquet(f"{tmp_path}/runs")
    for pages in (stored, stored.unionByName(stored), stored.select("page_id", "url", "scraped_at", "html")):
        best = latest_snapshot(pages)
        assert sorted((r.page_id, r.url, r.html) for r in best.filter("url IS NOT NULL").collect()) == \
            [("p1", "u", "a"), ("p3", "w", "f"), ("p8", "v", "d")]
        assert [(r.page_id, r.html) for r in best.filter("url IS NULL").collect()] == [("p4", "g")]
        assert not re.search(r"(?<!Broadcast)Exchange(?!.*places)", plan_of(best))
