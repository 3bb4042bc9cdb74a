"""Robots rules against the standard parser, keyword options, routing and the
order of the gates."""
import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from webloom.operators import gates as G
from webloom.plans.scrape import scrape_pages

RUN_TS = "2026-01-01 00:00:00"
PATHS = ["/", "/a", "/a/b", "/%7Ejoe/", "/~joe/x", "/café/", "/caf%C3%A9/x", "/a%2Fb", "/a b", "/x?q=1", "/x;p#f", "*", "", "/*", "/A"]
LINES = (["User-agent: EthicalWebScraper", "User-agent: *", "User-agent: other", "user-agent: ethical", "", "# note", "Crawl-delay: 3",
          "Crawl-delay: x", "Request-rate: 1/5", "Sitemap: https://x/s.xml", "nonsense", "Disallow", "Allow:/a # c"]
         + [f"{k}: {p}" for k in ("Disallow", "Allow") for p in PATHS])


def test_robots_equal_the_standard_parser(spark):
    rng = random.Random(3)
    files = [(f"http://h{i}.example", "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    urls = [(o + rng.choice(["", "/", "/a/b/c", "/~joe/x", "/%7ejoe/x", "/caf%c3%a9/x", "/café/x", "/a%2fb", "/a b", "/x?q=1", "/x;p#f", "/A/z"]),)
            for o, _ in files for _ in range(6)]
    got = G.robots_allowed(spark.createDataFrame(urls, "url string"), spark.createDataFrame(files, "origin string, body string")).collect()
    parsers = {}
    for origin, body in files:
        parsers[origin] = RobotFileParser()
        parsers[origin].parse(body.splitlines())
    for r in got:
        p = parsers["http://" + r.url.split("/")[2]]
        assert r.allowed == p.can_fetch(G.ROBOTS_AGENT, r.url), (r.url, dict(files)["http://" + r.url.split("/")[2]])
        assert r.crawl_delay == float(p.crawl_delay(G.ROBOTS_AGENT) or (0 if p.crawl_delay(G.ROBOTS_AGENT) == 0 else 1.0))


def test_word_boundary_option(spark):
    df = spark.createDataFrame([(1, "we improve things"), (2, "prove it")], "id long, t string")
    pick = lambda **k: [r[0] for r in df.orderBy("id").select(F.expr(G.captcha_by_text_sql("t", ["prove"], **k))).collect()]
    assert pick() == ["prove", "prove"] and pick(word_boundary=True) == [None, "prove"]
    kw = spark.createDataFrame([("prove", 1), ("it", 2)], "keyword string, ord int")
    rows = G.keyword_first_match(df, kw, "id", "t", word_boundary=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, 0), (2, "prove", 2)]


TEXT = "<p>" + "plain words of a page that is long enough to be kept here. " * 5 + "</p>"
ROWS = [  # id, url, html, status, server, type, error, route
    (1, "https://h.example/a", TEXT, 200, "nginx", "static", None, "static"),
    (2, "https://h.example/b", TEXT, 200, "nginx", "dynamic", None, "dynamic"),
    (3, "https://h.example/c", TEXT + "<i>React</i>", 200, "nginx", "auto", None, "dynamic"),
    (4, "https://h.example/d", TEXT, 200, "nginx", "weird", "Invalid scraping type. Must be static, dynamic, or auto", None),
    (5, "http://localhost/", TEXT, 200, "nginx", "static", "Cannot scrape private or localhost URLs", None),
    (6, "https://h.example/no/x", TEXT, 200, "nginx", "static", G.MSG_ROBOTS, None),
    (7, "https://h.example/e", TEXT, 200, "CloudFlare", "static", G.MSG_CAPTCHA, None),
    (8, "https://h.example/f", TEXT, 404, "nginx", "static", G.MSG_NO_DATA, None),
    (9, "https://h.example/g", TEXT, 503, "nginx", "static", G.MSG_CAPTCHA, None),
    (10, "https://h.example/h", TEXT + '<i class="captcha"></i>', 200, "nginx", "static", G.MSG_CAPTCHA, "static"),
    (11, "https://h.example/i", TEXT + '<i class="captcha"></i>', 301, "nginx", "dynamic", G.MSG_NO_DATA, "dynamic"),
    (12, "https://h.example/j", TEXT + "<form action='http://[x'></form>", 200, "nginx", "static", G.MSG_NO_DATA, "static"),
    (13, "https://h.example/k", "", 200, "nginx", "static", G.MSG_NO_DATA, "static"),
]


def test_gates_in_order_and_routes(spark):
    rows = [(r[0], r[1], f"<html><body>{r[2]}</body></html>" if r[2] else "", *r[3:6]) for r in ROWS]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, http_status_code int, server string, scraping_type string") \
        .withColumn("headers", F.create_map(F.lit("server"), "server")).drop("server")
    robots = spark.createDataFrame([("https://h.example", "User-agent: *\nDisallow: /no/")], "origin string, body string")
    out = {int(r.page_id): r for r in scrape_pages(df, RUN_TS, robots).select("page_id", "status", "error", "route").collect()}
    for i, *_, error, route in ROWS:
        assert (out[i].error, out[i].route, out[i].status) == (error, route, "error" if error else "success"), i


def test_no_parsed_page_is_shuffled(spark):
    df = spark.createDataFrame([r[:3] for r in ROWS], "page_id long, url string, html string")
    robots = spark.createDataFrame([("https://h.example", "User-agent: *\nDisallow: /no/")], "origin string, body string")
    plan = scrape_pages(df, RUN_TS, robots)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in above
