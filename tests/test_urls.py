"""URL functions against urllib.parse on generated strings, and request
predicates on fixed cases."""
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

import url_cases
from webloom.functions import urls as U


def test_urljoin_netloc_host_parity(spark):
    hrefs = url_cases.gen(600, seed=11)
    rows = [(b, h) for b in url_cases.BASES for h in hrefs[:60]] + [(url_cases.BASES[0], h) for h in hrefs]
    df = spark.createDataFrame(rows, "base string, href string")
    out = df.select("base", "href", U.url_join("base", "href").alias("j"), U.url_netloc("href").alias("n"),
                    U.url_host("href").alias("h"), U.url_scheme("href").alias("s"), U.url_split("href").alias("p")).collect()
    for r in out:
        try:
            p = urlparse(r.href)
        except ValueError:
            assert not r.p.ok, r.href
            continue
        assert r.p.ok, r.href
        try:
            exp = urljoin(r.base, r.href)
        except ValueError:
            continue
        assert r.j == exp, (r.base, r.href)
        assert (r.n, r.h, r.s) == (p.netloc, p.hostname, p.scheme), r.href


CASES = [
    # url, scrapable (P6), suspicious (P7), private (P8), valid link
    ("http://localhost/x", True, True, True, True),
    ("http://10.1.2.3/a", True, True, True, True),
    ("https://h.com/v10.2", True, True, False, True),
    ("https://h.com:80/p", False, False, False, True),
    ("ftp://h/f", False, True, False, False),
    ("https://a b.com/", False, False, False, False),
    ("#top", False, False, True, False),
    ("MAILTO:x@y", False, True, True, False),
    ("https://[::1]/", False, False, True, True),
    ("http://[abc]/", False, False, True, False),
]


def test_request_predicates(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    got = {r.url: r for r in df.select("url", U.is_scrapable_url("url").alias("a"), U.is_suspicious_url("url").alias("b"),
                                       U.is_private_url("url").alias("c"), U.is_valid_url("url").alias("d")).collect()}
    for url, a, b, c, d in CASES:
        r = got[url]
        assert (r.a, r.b, r.c, r.d) == (a, b, c, d), url


def test_validate_request_order(spark):
    df = spark.createDataFrame([("http://localhost/x", "static"), ("https://ok.example/", "bogus"),
                                ("https://h.com/v10.2", "auto")], "url string, t string")
    out = {r.url: r.v for r in df.select("url", U.validate_request("url", "t").alias("v")).collect()}
    assert out["http://localhost/x"].message == "Cannot scrape private or localhost URLs"
    assert out["https://ok.example/"].message.startswith("Invalid scraping type")
    assert out["https://h.com/v10.2"].valid and len(out["https://h.com/v10.2"].warnings) == 1
