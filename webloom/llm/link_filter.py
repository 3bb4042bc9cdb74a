"""URL filter by propagation over the host link graph.

Rules (host, path, verdict) decide the URLs that they fit.  The rest is judged
by host: trust is a personalised PageRank from trusted seed hosts along links
(who is linked by good hosts is good), distrust one from blocked seed hosts
along reversed links (who links to bad hosts is bad), and a host whose distrust
passes its threshold and its trust is blocked.

Seeds: a host of which rules allow more than half of all pages is trusted, one
of which rules block more than half is blocked.  Every seed of a kind starts
with the same share of TOTAL units.

Ranks are whole numbers: in each round a host keeps its flow as rank and hands
85 % of it on, in equal parts over its distinct link targets (distrust: its
distinct link sources), rounded down.  So the sums do not depend on their
order, reruns agree, and flows end by themselves.  What reaches a host without
targets stays there.  No task holds a host: links are pre-aggregated to
distinct pairs, and flows are summed with partial aggregates.

All of it is DataFrame work; rounds are cut by tables in the shared folder.

Defined results: a null URL, and one without ``://``, has empty host and path
(no rule, no rank: allowed); null html has no links; repeated page rows are
judged each; an empty table gives an empty result.  Other columns of the input
are not looked at, whatever their names.  Very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, joined

#: Units that the seeds of one kind share at the start.
TOTAL = 10 ** 15
#: Share of a flow that is handed on, in percent, and the most rounds of it
#: (0.85 ** 40 of the seeds' units, 0.15 %, may be on the way then).
DAMPING, ROUNDS = 85, 40
#: A host is blocked from this share, in percent, of a blocked seed's start on.
THRESHOLD = 50

_WS = r"\x20\x09-\x0D"
#: Parts of a page whose links are not links of the page.
HIDDEN = (rf"(?is)<!--.*?(?:-->|\z)|<script[{_WS}>].*?(?:</script|\z)|<style[{_WS}>].*?(?:</style|\z)"
          rf"|<template[{_WS}>].*?(?:</template|\z)")
#: Host of an absolute or scheme-relative http link of an anchor.
LINK = (rf"""(?i)<a[{_WS}/](?:[^<>]*?[{_WS}"'/])?href[{_WS}]*=[{_WS}]*["']?[{_WS}]*(?:https?:)?//"""
        rf"""([^/?#"'<>\x00-\x20]+)""")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits, else
    null.  The rules are configuration and become one expression."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct pairs (src, dst) of different hosts: src has a page with an
    anchor to dst.  Links in comments, scripts, styles and templates are none."""
    shown = F.regexp_replace(F.col(f"`{html_col}`"), HIDDEN, " ")
    return (pages.select(host_of(F.col(f"`{url_col}`")).alias("src"),
                         F.array_distinct(F.regexp_extract_all(shown, F.lit(LINK), F.lit(1))).alias("to"))
            .select("src", F.explode("to").alias("to"))
            .select("src", F.translate("to", UPPER, LOWER).alias("dst"))
            .filter("src <> '' AND src <> dst").distinct())


def spread(seeds: DataFrame, edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Rank per (kind, host): what flows there from ``seeds`` (kind, host, flow)
    along ``edges`` (kind, src, dst), summed over the rounds."""
    degrees = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    edges = scratch.written(joined(edges, scratch.written(degrees, "links-degrees"), ["kind", "src"], "inner"),
                            "links-edges")
    flow = scratch.written(seeds, "links-seeds")
    ranks = flow
    for _ in range(rounds):
        step = (joined(edges, flow.withColumnRenamed("host", "src"), ["kind", "src"], "inner")
                .select("kind", F.col("dst").alias("host"),
                        F.expr(f"(flow * {DAMPING} div 100) div degree").alias("flow")).filter("flow > 0")
                .groupBy("kind", "host").agg(F.sum("flow").alias("flow")))
        flow = scratch.written(step, "links-flow")
        if flow.isEmpty():
            break
        ranks = ranks.union(flow)
    return ranks.groupBy("kind", "host").agg(F.sum("flow").alias("rank"))


def host_ranks(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", html_col: str = "html",
               scratch: Scratch | None = None) -> DataFrame:
    """Per host with a rank: trust, distrust, blocked."""
    scratch = scratch or Scratch(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    seen = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).filter("host <> ''")
    counts = seen.select("host", matched(F.col("host"), F.col("path"), rules)[1].alias("says")).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("says") == "allow").alias("good"),
        F.count_if(F.col("says") == "block").alias("bad"))
    hosts = scratch.written(counts.select("host", F.expr("CASE WHEN 2 * good > n THEN 'trust' "
                                                         "WHEN 2 * bad > n THEN 'distrust' END AS kind"))
                            .filter("kind IS NOT NULL"), "links-hosts")
    shares = {r["kind"]: TOTAL // r["n"] for r in hosts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = F.when(F.col("kind") == "trust", F.lit(shares.get("trust", 0))).otherwise(F.lit(shares.get("distrust", 0)))
    pairs = scratch.written(host_edges(pages, url_col, html_col), "links-pairs")
    edges = (pairs.select(F.lit("trust").alias("kind"), "src", "dst")
             .union(pairs.select(F.lit("distrust"), F.col("dst"), F.col("src"))))
    ranks = spread(hosts.select("kind", "host", start.cast("long").alias("flow")), edges, scratch)
    by_host = ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0)).alias("distrust"))
    least = max(1, shares.get("distrust", 0) * THRESHOLD // 100)
    return by_host.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= F.lit(least)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """Per page row: page_id, host, path, rule (text of the rule that decides,
    else null), verdict (allow or block), trust and distrust of its host."""
    scratch = Scratch(pages.sparkSession)
    ranks = host_ranks(pages, rules, url_col, html_col, scratch).withColumnRenamed("host", "ranked")
    ranks = Scratch(pages.sparkSession).written(ranks, "links-ranks")
    scratch.drop()
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("says"))
    out = joined(rows, ranks, F.col("host") == F.col("ranked"), "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("says", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
