"""Readers/writers (S2, S3, S5-S7) and stream = batch parity."""
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from webloom.sources import files as S
from webloom.operators import runs as RN
from webloom.plans import derived as DV
from webloom.streaming import stream as X

SF = "/root/testdata/sf0.001"


def test_ragged_csv_reads_new_columns_as_null(spark):
    d = tempfile.mkdtemp(prefix="wl-csv-")
    p = os.path.join(d, "pages.csv")
    with open(p, "w", newline="") as f:
        f.write("page_id,url,title,scraped_at,text_length,paragraph_count,heading_count,image_count,form_count\r\n")
        f.write('a,https://x/,"T, with comma",2026-02-15T15:04:10+00:00,10,1,1,0,0\r\n')
        f.write("b,https://x/,T2,2026-02-16T00:10:10+00:00,20,2,2,21,0,200,33\r\n")
    rows = {r.page_id: r for r in S.scan_ragged_csv(spark, p, "pages").collect()}
    assert rows["a"].title == "T, with comma" and rows["a"].http_status_code is None
    assert rows["b"].http_status_code == 200 and rows["b"].response_time_ms == 33


def test_flat_json_split(spark):
    d = tempfile.mkdtemp(prefix="wl-json-")
    p = os.path.join(d, "scraped.json")
    with open(p, "w") as f:
        f.write('[{"url": "u", "title": "t", "links_count": 1},'
                '{"url": "u", "record_type": "link", "link_number": 1, "link_url": "https://x/", "is_external": true},'
                '{"url": "u", "record_type": "heading", "heading_number": 1, "heading_level": 2, "heading_text": "h"}]')
    pages, links, heads = S.scan_flat_json(spark, p)
    assert (pages.count(), links.count(), heads.count()) == (1, 1, 1)
    assert links.first().link_url == "https://x/"


def test_writers_partition_and_append(spark):
    from webloom.operators.process import images_table, links_table
    from webloom.plans import queries as Q
    rec = Q.records(spark, SF)
    d = tempfile.mkdtemp(prefix="wl-out-")
    tables = {"pages": Q.pages_table(rec), "links": links_table(rec, ("url",)), "images": images_table(rec, ("url",))}
    for _ in range(2):                               # a repeated write changes nothing
        S.write_run_tables(tables, d)
    back, links = spark.read.parquet(f"{d}/pages"), spark.read.parquet(f"{d}/links")
    assert back.count() == Q.pages_table(rec).count() and "host" in back.columns
    assert links.count() == Q.links_table(rec).count() and "url" not in links.columns
    assert {r.host for r in links.select("host").distinct().collect()} <= {r.host for r in back.select("host").distinct().collect()}
    with pytest.raises(ValueError):
        S.write_run_tables({"links": Q.links_table(rec)}, d)
    for _ in range(2):
        S.append_master(Q.pages_table(rec).drop("http_status_code", "response_time_ms"), f"{d}/master", "pages", "r1")
        S.append_master(Q.pages_table(rec), f"{d}/master", "pages", "r2")
    m = S.read_master(spark, f"{d}/master", "pages")
    assert m.count() == 2 * back.count() and m.filter("http_status_code IS NULL").count() == back.count()
    assert m.first().scraped_at.endswith("Z")
    S.write_flat_json(rec, f"{d}/flat")
    pages, flat_links, _ = S.scan_flat_json(spark, f"{d}/flat", multi_line=False)
    assert flat_links.count() == Q.links_table(rec).count() and pages.first().text_content


def test_stream_process_matches_batch(spark):
    from webloom.plans import queries as Q
    from webloom.plans.scrape import scrape_pages
    stream_links = Q.QUERIES["stream_process"](spark, SF)
    batch = scrape_pages(Q.table(spark, SF, "pages"), Q.RUN_TS, DV.robots_files(spark, SF)).filter("status = 'success'")
    from webloom.operators.process import links_table
    cols = ["page_id", "link_number", "link_url"]
    a = sorted(tuple(r) for r in stream_links.select(*cols).collect())
    b = sorted(tuple(r) for r in links_table(batch).select(*cols).collect())
    assert a == b and len(a) > 0


def test_session_state_stream_equals_batch(spark):
    ev = DV.sessions(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r.session_id: (r.progress, r.step, r.status) for r in RN.session_state(ev).collect()}
    d = tempfile.mkdtemp(prefix="wl-ev-")
    ev.write.parquet(f"{d}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{d}/ev")
    q = X.stream_session_state(stream).writeStream.format("memory").queryName("wl_sessions").outputMode("update") \
        .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.session_id: (r.progress, r.step, r.status) for r in spark.table("wl_sessions").collect()}
    assert got == batch


def test_robots_refresh_after_each_ttl_however_batched(spark):
    rows = [("a", 0), ("a", 3599), ("a", 3600), ("a", 3601), ("a", 7199), ("a", 7200), ("b", 50), ("b", 10), ("b", 3615), ("b", 3605)]
    df = spark.createDataFrame(rows, "host string, t long").selectExpr("host", "timestamp_seconds(t + 360000) AS ts")      # not at the epoch: late for any stream
    want = [("a", 0), ("a", 3600), ("a", 7200), ("b", 10), ("b", 3615)]
    for parts in (1, 2):
        d = tempfile.mkdtemp(prefix="wl-rr-")
        early = F.unix_seconds("ts") < 363600
        for k, part in enumerate([df] if parts == 1 else [df.filter(early), df.filter(~early)]):
            part.coalesce(1).write.parquet(f"{d}/in/{k}")
            os.makedirs(f"{d}/flat", exist_ok=True)
            for f in os.listdir(f"{d}/in/{k}"):
                if f.endswith(".parquet"):
                    shutil.copy(f"{d}/in/{k}/{f}", f"{d}/flat/{k}-{f}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/flat")
        path = X.run_to_the_end(stream, X.robots_refresh, "rr", "host")
        got = spark.read.parquet(path).select("host", (F.unix_seconds("ts") - 360000).alias("t")).collect()
        assert sorted(map(tuple, got)) == (want if parts == 1 else [w if w != ("b", 3615) else ("b", 3615) for w in want])


def _files(df, parts, where):
    """One Parquet file for each filter, in the order in which a stream takes them."""
    for k, part in enumerate(parts):
        df.filter(part).coalesce(1).write.parquet(f"{where}/in/{k}")
        os.makedirs(f"{where}/flat", exist_ok=True)
        for f in os.listdir(f"{where}/in/{k}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{where}/in/{k}/{f}", f"{where}/flat/{k}-{f}")
                os.utime(f"{where}/flat/{k}-{f}", (1_000_000 + k, 1_000_000 + k))
    return f"{where}/flat"


def test_robots_refresh_does_not_depend_on_the_order_of_arrival(spark):
    import random

    rng = random.Random(9)
    rows = [(h, rng.randrange(1, 40_000)) for h in ["hot"] * 3000 + [f"h{i}" for i in range(30)] * 20]
    df = spark.createDataFrame(rows, "host string, t long").selectExpr("host", "timestamp_seconds(t) AS ts").cache()
    want = []
    for host in {h for h, _ in rows}:
        last = None
        for t in sorted(t for h, t in rows if h == host):
            if last is None or t >= last + 3600:
                last = t
                want.append((host, t))
    shuffled = [F.expr(f"pmod(xxhash64(host, ts), 4) = {k}") for k in range(4)]
    by_time = [F.unix_seconds("ts").between(10_000 * k, 10_000 * k + 9_999) for k in (0, 1, 2, 3)]
    for parts in (shuffled, by_time, by_time[::-1]):
        flat = _files(df, parts, tempfile.mkdtemp(prefix="wl-order-"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(flat)
        path = X.run_to_the_end(stream, lambda s: X.robots_refresh(s, watermark="1 day"), "order", "host")
        got = spark.read.parquet(path).select("host", F.unix_seconds("ts").alias("t")).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_session_state_does_not_depend_on_the_order_of_arrival(spark):
    ev = DV.sessions(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).filter("session_id < '3'")
    ev = ev.withColumn("session_id", F.expr("CASE WHEN seq % 3 = 0 THEN 'hot' ELSE session_id END")).cache()
    stops = ev.filter("seq % 5 = 0").select("session_id", F.expr("ts + INTERVAL 1 SECOND").alias("ts")).cache()
    kept = {}
    for r in sorted([(r.session_id, r.ts, False, r.seq, r.progress, r.step, r.status) for r in ev.collect()]
                    + [(r.session_id, r.ts, True, 0, 0.0, "", "") for r in stops.collect()]):
        sid, ts, is_stop, seq, progress, step, status = r
        was = kept.get(sid)
        if was and was[2] == "stopped":
            continue
        if not is_stop:
            kept[sid] = (progress, step, status)
        elif was and was[2] not in RN.FINISHED_STATES:
            kept[sid] = (was[0], was[1], "stopped")
    for salt in (1, 2):
        d = tempfile.mkdtemp(prefix="wl-mix-")
        flat = [_files(df, [F.expr(f"pmod(xxhash64({salt}, ts), 3) = {k}") for k in range(3)], f"{d}/{name}") for name, df in (("e", ev), ("s", stops))]
        read = lambda path, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = X.run_updates(X.stream_session_state(read(flat[0], ev), read(flat[1], stops), "400 days"), "mix", "session_id")
        assert {r.session_id: (r.progress, r.step, r.status) for r in out.collect()} == kept


def test_stream_stops_end_active_sessions(spark):
    ev = spark.createDataFrame([("s1", 10, 1, 20.0, "fetch", "running"), ("s2", 10, 2, 100.0, "done", "completed")],
                               "session_id string, t long, seq long, progress double, step string, status string") \
        .selectExpr("session_id", "timestamp_seconds(t) AS ts", "seq", "progress", "step", "status")
    stops = spark.createDataFrame([("s1", 20), ("s2", 20), ("s9", 20)], "session_id string, t long") \
        .selectExpr("session_id", "timestamp_seconds(t) AS ts")
    d = tempfile.mkdtemp(prefix="wl-st-")
    ev.write.parquet(f"{d}/ev")
    stops.write.parquet(f"{d}/stops")
    q = X.stream_session_state(spark.readStream.schema(ev.schema).parquet(f"{d}/ev"), spark.readStream.schema(stops.schema).parquet(f"{d}/stops")) \
        .writeStream.format("memory").queryName("wl_stops").outputMode("update").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.session_id: r.status for r in spark.table("wl_stops").orderBy("updated_at").collect()}
    assert last == {"s1": "stopped", "s2": "completed"}


def test_session_state_lists_sessions_before_their_first_event(spark):
    ev = spark.createDataFrame([("a", 1, 5, 30.0, "x", "running")], "session_id string, t long, seq long, progress double, step string, status string") \
        .withColumn("ts", F.timestamp_seconds("t"))
    started = spark.createDataFrame([("a",), ("b",)], "session_id string")
    got = {r.session_id: (r.progress, r.step) for r in RN.session_state(ev, started).collect()}
    assert got == {"a": (30.0, "x"), "b": (0.0, "Initializing")}


def test_run_logs_have_line_numbers(spark):
    d = tempfile.mkdtemp(prefix="wl-log-")
    with open(f"{d}/m.log", "w") as f:
        f.write("2026-02-15 20:34:10,123 - scraping_manager - INFO - Starting scraping session s1 for https://x/\n"
                "2026-02-15 20:34:12,500 - scraping_manager - INFO - Successfully scraped https://x/\n")
    rows = S.scan_run_logs(spark, f"{d}/m.log").orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 2] and rows[0].session_id == "s1" and rows[1].url == "https://x/"


def test_csv_files_are_read_by_their_own_header(spark):
    d = tempfile.mkdtemp(prefix="wl-csvh-")
    files = {"a b.csv": "page_id,url,title,scraped_at,text_length,paragraph_count,heading_count,image_count,form_count\r\n"
                        "a,https://x/,T,2026,1,2,3,4,5\r\nb,https://x/,T2,2026,6,7,8,9,10,200,33\r\n",
             "c.csv": "url,http_status_code,page_id,odd\r\nhttps://y/,404,c,zzz\r\n", "empty.csv": ""}
    for name, text in files.items():
        with open(f"{d}/{name}", "w", newline="") as f:
            f.write(text)
    out = S.scan_ragged_csv(spark, d, "pages")
    assert out.schema == S.PAGES_SCHEMA
    rows = {r.page_id: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].form_count, rows["a"].http_status_code) == (5, None) and (rows["b"].http_status_code, rows["b"].response_time_ms) == (200, 33)
    assert (rows["c"].url, rows["c"].http_status_code, rows["c"].title) == ("https://y/", 404, None)


def test_a_large_host_is_written_by_many_tasks(spark):
    rows = [(i, "https://hot.example/" + "x" * 50 + str(i)) for i in range(20_000)] + [(30_000 + i, f"https://h{i % 40}.example/{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("scraped_at", F.timestamp_seconds(F.lit(10 ** 9))).repartition(8)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    d = tempfile.mkdtemp(prefix="wl-hot-")
    try:
        spark.conf.set(key, "32k")
        S.write_run_tables({"pages": df}, d)
    finally:
        spark.conf.set(key, was)
    count = lambda h: len([f for f in os.listdir(f"{d}/pages/host={h}/run_ts=20010909_014640") if f.endswith(".parquet")])
    small = [count(f"h{i}.example") for i in range(40)]        # few share the shuffle partition of the large one
    assert count("hot.example") >= 4 and sum(n == 1 for n in small) >= 30
    assert spark.read.parquet(f"{d}/pages").count() == len(rows)


def test_stream_queries_read_a_table_that_is_a_folder(spark):
    from webloom.plans.queries import QUERIES

    files, folders = tempfile.mkdtemp(prefix="wl-file-"), tempfile.mkdtemp(prefix="wl-folder-")
    words = " ".join(f"word{i}" for i in range(60))
    pages = spark.range(12).selectExpr("id AS page_id", "concat('https://blog.example.com/en/', id) AS url",
                                       f"concat('<html><body><p>{words}</p><a href=\"/x', id, '\">a</a></body></html>') AS html")
    events = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 700) AS ts", "id % 7 AS user_id",
                                         "element_at(array('click', 'view', 'error'), CAST(id % 3 + 1 AS INT)) AS event_type",
                                         "CAST(id % 100 AS DOUBLE) AS value", "'{}' AS props")
    for name, df in (("pages", pages), ("events", events)):
        df.repartition(3).write.parquet(f"{folders}/{name}.parquet")
        df.coalesce(1).write.parquet(f"{files}/{name}")
        part = next(f for f in os.listdir(f"{files}/{name}") if f.endswith(".parquet"))
        shutil.copy(f"{files}/{name}/{part}", f"{files}/{name}.parquet")
    for query in ("stream_process", "stream_session_state", "robots_refresh"):
        one, many = (sorted(map(tuple, QUERIES[query](spark, d).collect())) for d in (files, folders))
        assert one and one == many, query


class _Handle:
    """State of one key in memory, with the calls that a processor makes."""

    def __init__(self):
        self.calls, self.timers, self.states, self.now = 0, set(), {}, 0

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _State(self))

    getListState = getValueState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def listTimers(self):
        return iter(sorted(self.timers))

    def getCurrentWatermarkInMs(self):
        return self.now

    def expire(self, processor, key, now):
        self.now, out = now, []
        for ms in sorted(t for t in self.timers if t <= now):
            info = type("Info", (), {"getExpiryTimeInMs": lambda self, ms=ms: ms})()
            out += list(processor.handleExpiredTimer(key, self, info))
            self.timers.discard(ms)
        return out


class _State:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def exists(self):
        return self.value is not None

    def get(self):
        self.handle.calls += 1
        return iter(list(self.value or [])) if isinstance(self.value, list) or self.value is None else self.value

    def update(self, value):
        self.handle.calls += 1
        self.value = value

    def appendList(self, values):
        self.handle.calls += 1
        self.value = (self.value or []) + list(values)

    def clear(self):
        self.value = None


def test_a_host_of_many_slots_takes_few_calls_of_the_state(spark, monkeypatch):
    import random

    import pandas as pd

    rng = random.Random(4)
    times = [rng.randrange(1, 3_000 * 3600) * 1_000_000 for _ in range(6000)]
    want, last = [], None
    for t in sorted(times):
        if last is None or t >= last + 3_600_000_000:
            last = t
            want.append(t)
    for held in (X.HELD if hasattr(X, "HELD") else 0, 500):       # 500: read in windows of slots
        monkeypatch.setattr(X, "HELD", held, raising=False)
        handle, host = _Handle(), X.Refreshes(3_600_000_000)
        host.init(handle)
        for at in range(0, 6000, 1500):
            list(host.handleInputRows(("h",), iter([pd.DataFrame({"us": times[at:at + 1500]})]), handle))
        assert handle.calls <= 20 and len(handle.timers) <= 4      # before: some for every slot
        got = [t for now in (500 * 3_600_000, 501 * 3_600_000 + 5, 4_000 * 3_600_000) for f in handle.expire(host, ("h",), now) for t in f["us"]]
        assert got == want
        assert not handle.expire(host, ("h",), 5_000 * 3_600_000) and not handle.timers
        assert all(s.value is None for n, s in handle.states.items() if n != "use")     # nothing is remembered


def test_rows_of_a_session_wait_packed(spark):
    import random

    import pandas as pd

    rng = random.Random(5)
    rows = [(rng.randrange(1, 10 ** 9), i, float(i), None if i % 9 == 0 else f"s{i}", "running" if i % 3 else "completed", i % 50 == 0) for i in range(3000)]
    df = pd.DataFrame(rows, columns=["us", "seq", "progress", "step", "status", "is_stop"])
    handle, sessions = _Handle(), X.Sessions()
    sessions.init(handle)
    out = list(sessions.handleInputRows(("a",), iter([df]), handle))
    assert sum(len(s.value) for n, s in handle.states.items() if n.startswith("rows") and s.value) <= 3      # before: 3000
    last = None
    for us, seq, progress, step, status, is_stop in sorted(rows, key=lambda r: (r[0], r[5], r[1])):
        if not is_stop:
            last = (us, progress, step, status)
        elif last is not None and last[3] == "running":
            last = (us, last[1], last[2], "stopped")
            break
    got = out[0].iloc[0]
    assert (got["updated_at"].value // 1000, got["progress"], got["step"], got["status"]) == last
