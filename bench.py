"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Each query is fully executed (``write.format("noop")``), so every row is
produced; timings include planning.  ``pages_per_sec`` reports the
end-to-end parse → extract → process → tables rate for the flagship query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "links_table", "pages_table", "page_statistics", "extract_text", "extract_links",
    "headings_table", "images_table", "gate_pipeline", "robots_allowed", "host_rollup",
    "session_state", "latest_snapshot", "clean_text", "word_count", "validate_request",
    "scrape_pages", "flatten_records", "extract_meta", "keyword_semi_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from webloom.session import get_session
    from webloom.plans import queries as Q

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="webloom-bench")
    # The parse is bound by CPU: cut the small files into a split for each core.
    spark.conf.set("spark.sql.files.minPartitionNum", str(int(cpus) * 2))
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    # Warm-up: JVM, Python workers and codegen caches (not timed).
    Q.QUERIES["extract_title"](spark, sf_dir).write.mode("overwrite").format("noop").save()

    # Each query twice: cold (planning and compiling included), then warm.
    times, warm = {}, {}
    for name in HEADLINE:
        if name not in Q.QUERIES:
            continue
        for into in (times, warm):
            t0 = time.time()
            Q.QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
            into[name] = round(time.time() - t0, 3)

    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_query_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "warm": warm,
        "warm_total": round(sum(warm.values()), 3),
        "sf": sf,
        "cpus": int(cpus),
        "pages": n_pages,
        "pages_per_sec_links_table": round(n_pages / times["links_table"], 1) if times.get("links_table") else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
