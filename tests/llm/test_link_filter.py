"""Trust and distrust over planted links, against a plain version."""
import re
from collections import defaultdict

from webloom.llm import link_filter

RULES = [("net", "/", "block"), ("good.org", "/", "allow"), ("b.net", "/en/", "allow")]


def page(*hosts):
    return "<p>" + "".join(f'<a class="x" href="{h}">t</a>' for h in hosts) + "</p>"


ROWS = [
    (1, "http://good.org/a", page("http://Fine.com/x", "https://deep.com?q")),
    (2, "https://GOOD.org/b", page("//fine.com", "/local", "mailto:x@spam.net")),
    (3, "http://fine.com/", page("http://deep.com/")),
    (4, "http://deep.com/1", None),
    (5, "http://spam.net/1", page("http://fine.com/")),
    (6, "http://farm.com/1", page("http://spam.net/", "http://b.net/")),
    (7, "http://farm.com/2", "<!-- <a href='http://good.org/'> --><script>'<a href=\"http://good.org/\">'</script>"
     "<a data-href='http://good.org/' href=http://spam.net>x</a>"),
    (8, "http://b.net/en/x", ""),
    (9, "http://b.net/de/x", ""),
    (10, "http://b.net/de/y", ""),
    (11, "http://feeder.com/", page("http://farm.com/")),
    (12, None, page("http://spam.net/")),
    (13, "no scheme", page("http://spam.net/")),
    (None, "http://fine.com/2?x", ""),
    (9, "http://b.net/de/x", ""),
    (16, "http://x.net", ""),
]


def plain(rows, rules):
    """The definition, row by row."""
    judged, links, by_host = [], set(), defaultdict(list)
    for pid, url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        judged.append((pid, host, path, best))
        if host:
            by_host[host].append(best and best[2])
            shown = re.sub(r"(?s)<!--.*?-->|<script.*?</script", " ", html or "")
            for tag in re.findall(r"<a [^>]*>", shown):
                at = re.search(r"""[ "']href=["']?(?:https?:)?//([^/?#"'> ]+)""", tag)
                if at and at[1].lower() != host:
                    links.add((host, at[1].lower()))
    ranks = {}
    for kind, says, edges in (("trust", "allow", links), ("distrust", "block", {(b, a) for a, b in links})):
        seeds = [h for h, v in by_host.items() if 2 * sum(x == says for x in v) > len(v)]
        flow = {h: link_filter.TOTAL // len(seeds) for h in seeds}
        rank, out = defaultdict(int, flow), defaultdict(list)
        for a, b in edges:
            out[a].append(b)
        for _ in range(link_filter.ROUNDS):
            after = defaultdict(int)
            for a, units in flow.items():
                for b in out[a]:
                    after[b] += units * link_filter.DAMPING // 100 // len(out[a])
            flow = after
            for h, units in flow.items():
                rank[h] += units
        ranks[kind] = rank, len(seeds)
    least = link_filter.TOTAL // max(1, ranks["distrust"][1]) * link_filter.THRESHOLD // 100
    got = []
    for pid, host, path, rule in judged:
        t, d = ranks["trust"][0][host] if host else 0, ranks["distrust"][0][host] if host else 0
        by_rank = "block" if d > t and d >= least else "allow"
        got.append((pid, host, path, rule and rule[0] + rule[1], rule[2] if rule else by_rank, t, d))
    return sorted(got, key=str)


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'h' AS host", "1 AS rank", "'k' AS kind", "0 AS flow", "'v' AS verdict", "2 AS src")


def test_equals_the_definition_on_planted_links(spark):
    got = sorted(map(tuple, link_filter.judge(pages_of(spark, ROWS), RULES).collect()), key=str)
    assert got == plain(ROWS, RULES)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[6] == verdict[7] == verdict[11] == "block"   # nothing but links to blocked hosts, or to who has them
    assert verdict[3] == verdict[4] == "allow"
    assert verdict[12] == verdict[13] == "allow" and verdict[16] == "allow"     # empty path: no rule


def test_hot_host_and_long_page(spark):
    rows = [(i, f"http://hub.com/{i}", page(*(f"http://h{j}.com/" for j in range(i % 7, 300, 7)))) for i in range(600)]
    rows += [(1000 + j, f"http://h{j}.com/", page("http://hub.com/", f"http://h{j + 1}.com/")) for j in range(300)]
    rows += [(2000, "http://bad.net/", "x" * 1_000_000 + page("http://h1.com/")), (2001, "http://h3.com/", page("http://bad.net/"))]
    got = sorted(map(tuple, link_filter.judge(pages_of(spark, rows), RULES).collect()), key=str)
    assert got == plain(rows, RULES)


def test_empty_table(spark):
    assert link_filter.judge(pages_of(spark, ROWS).limit(0), RULES).collect() == []
