"""Gates: captcha (P10-P14), rendering (P15, P16), fetch (P20), robots
(J1, J2, J3), keyword tables (J5, A5) and the ordered gate pipeline (P19).

Everything is a Spark SQL expression or a DataFrame join:

* captcha and rendering checks read the page's DOM / markup columns;
* robots.txt bodies are compiled once per host (a fold over the file's
  lines — the standard robots parser's state machine) into one row of
  entries; URLs are then joined N:1 to their host's compiled rules, so
  no URL × rule pairs are ever produced.  The join is a plain equi-join on
  the origin: AQE broadcasts the rules side only when its measured size is
  under the broadcast threshold, and splits a hot host's partition when
  one origin holds much of the data;
* the as-of lookup of robots snapshots partitions by (host, TTL bucket)
  so a hot host is spread over time buckets instead of one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import expr, fresh, lam, let, q, qlist, struct
from ..functions.text import PY_WS, py_strip_sql
from ..functions.urls import url_split_sql
from ..session import staged
from .extract import selector_pred

# Captcha selectors and keyword lists, in priority order.
CAPTCHA_SELECTORS = [
    'iframe[src*="recaptcha"]',
    'iframe[src*="hcaptcha"]',
    '.g-recaptcha',
    '[data-sitekey]',
    '#captcha',
    '.captcha',
    '[class*="captcha"]',
    '[id*="captcha"]',
]
RENDERED_CAPTCHA_SELECTORS = [
    'iframe[src*="recaptcha"]',
    'iframe[src*="captcha"]',
    '.g-recaptcha',
    '#captcha',
    '[class*="captcha"]',
    '[id*="captcha"]',
]
GATE_KEYWORDS = ['captcha', 'recaptcha', 'hcaptcha', 'verify', 'verification', 'prove', 'robot', 'human']
STATIC_FETCH_KEYWORDS = ['captcha', 'recaptcha', 'verify', 'robot', 'human', 'prove']
RENDERED_KEYWORDS = ['captcha', 'verify', 'robot', 'human', 'prove']
BLOCKING_STATUS = [403, 429, 503]
# Markers that make a page "dynamic" (substring of lower-cased markup).
JS_INDICATORS = ['react', 'vue', 'angular', 'ember', 'backbone', 'webpack', 'parcel', 'rollup', 'vite']
SPA_INDICATORS = ['data-react', 'ng-app', 'v-app', '#app', '.app', 'router-view', 'component', 'directive']
MIN_STATIC_TEXT = 100
# Gate messages.
MSG_ROBOTS = "Robots.txt disallows scraping"
MSG_CAPTCHA = "CAPTCHA detected - scraping blocked"
MSG_NO_DATA = "Scraping failed - no data retrieved"
ROBOTS_AGENT = "EthicalWebScraper/1.0"
ROBOTS_TTL_SEC = 3600
DEFAULT_CRAWL_DELAY = 1.0


# --------------------------------------------------------------------------
# P10-P14 captcha

def captcha_by_selector_sql(d: str, selectors=CAPTCHA_SELECTORS) -> str:
    """P10: the first selector (list order) matching any element, or NULL."""
    cases = " ".join(f"WHEN exists({d}.nodes, {lam(selector_pred(s))}) THEN {q(s)}" for s in selectors)
    return f"CASE {cases} END"


def _keyword_hit(text: str, word: str, word_boundary: bool) -> str:
    if word_boundary:
        return f"regexp_like({text}, concat('\\\\b\\\\Q', {word}, '\\\\E\\\\b'))"
    return f"contains({text}, {word})"


def captcha_by_text_sql(text: str, keywords=GATE_KEYWORDS, word_boundary: bool = False) -> str:
    """First keyword (list order) that is a substring of the lower-cased
    page text, or NULL.  By default ``improve`` contains ``prove``; with
    ``word_boundary`` only whole words count."""
    def search(t):
        k = fresh()
        return f"try_element_at(filter(array({qlist(keywords)}), {k} -> {_keyword_hit(t, k, word_boundary)}), 1)"
    return let(f"lower({text})", search)


def blocked_by_headers_sql(headers: str) -> str:
    """The ``server`` response header mentions cloudflare."""
    return f"coalesce(contains(lower({headers}['server']), 'cloudflare'), false)"


def blocked_by_status_sql(status: str) -> str:
    """P13: 'content' for 200 (look at the page), 'blocked' for 403/429/503,
    'pass' otherwise."""
    return (f"CASE WHEN {status} = 200 THEN 'content' WHEN {status} IN ({', '.join(map(str, BLOCKING_STATUS))}) "
            f"THEN 'blocked' ELSE 'pass' END")


def gate_captcha_sql(d: str, status: str, headers: str, keywords=GATE_KEYWORDS) -> str:
    """Headers → (status 200: selectors → text) → status; a struct
    <has_captcha, type, indicator>."""
    def build(c):
        return (f"CASE WHEN {c}.hdr THEN {struct(('has_captcha', 'true'), ('type', q('header')), ('indicator', q('server: cloudflare')))} "
                f"WHEN {c}.st = 'content' AND {c}.sel IS NOT NULL THEN {struct(('has_captcha', 'true'), ('type', q('selector')), ('indicator', f'{c}.sel'))} "
                f"WHEN {c}.st = 'content' AND {c}.txt IS NOT NULL THEN {struct(('has_captcha', 'true'), ('type', q('text')), ('indicator', f'{c}.txt'))} "
                f"WHEN {c}.st = 'blocked' THEN {struct(('has_captcha', 'true'), ('type', q('status')), ('indicator', f'CAST({status} AS STRING)'))} "
                f"ELSE {struct(('has_captcha', 'false'), ('type', 'CAST(NULL AS STRING)'), ('indicator', 'CAST(NULL AS STRING)'))} END")
    facts = struct(("hdr", blocked_by_headers_sql(headers)), ("st", blocked_by_status_sql(f"coalesce({status}, 200)")),
                   ("sel", captcha_by_selector_sql(d)), ("txt", captcha_by_text_sql(f"{d}.text", keywords)))
    return let(facts, build)


# --------------------------------------------------------------------------
# P15 / P16 rendering

def markup_markers_sql(html: str) -> str:
    """True when the lower-cased markup has a JS-framework word or SPA marker."""
    return let(f"lower({html})", lambda h: "(" + " OR ".join(
        f"contains({h}, {q(m)})" for m in JS_INDICATORS + SPA_INDICATORS) + ")")


def classify_rendering_sql(marked: str, status: str, text_strip_len: str) -> str:
    """P15: 'dynamic' if the fetch status is not 200, or the markup has a
    marker (``marked``, from ``markup_markers_sql``), or the page has fewer
    than 100 visible characters; else 'static'."""
    return (f"CASE WHEN coalesce({status}, 200) != 200 OR {marked} OR coalesce({text_strip_len}, 0) < {MIN_STATIC_TEXT} "
            f"THEN 'dynamic' ELSE 'static' END")


def route_by_type_sql(req_type: str, rendering: str) -> str:
    """Explicit static/dynamic, else the auto-detected rendering."""
    return f"CASE WHEN {req_type} IN ('static', 'dynamic') THEN {req_type} ELSE {rendering} END"


def fetch_ok_sql(status: str) -> str:
    """P20: a 4xx/5xx fetch yields no record."""
    return f"coalesce({status}, 200) < 400"


# --------------------------------------------------------------------------
# J1 / J2 robots.txt

_LINE_SPLIT = "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}\\x{1D}\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def _plain_rules(body: str) -> str:
    """The lines of a robots.txt with percent-coded values decoded and rule
    paths in the one spelling that URLs are compared in."""
    out = []
    for line in body.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        if colon:
            value = unquote(value.strip())
            if key.strip().lower() in ("allow", "disallow"):
                value = quote(urlunparse(urlparse(value)))
            line = f"{key}:{value}".replace("\n", " ").replace("#", "%23")
        out.append(line)
    return "\n".join(out)


def _url_rule_path(url: str) -> str:
    """What of a URL the rules are compared with."""
    p = urlparse(unquote(url))
    return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"


def _each(fn, on_error):
    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            try:
                return None if x is None else fn(x)
            except ValueError:
                return on_error
        for batch in batches:
            yield batch.map(one, na_action=None)
    return apply


def compile_robots(robots: DataFrame, origin_col: str = "origin", body_col: str = "body") -> DataFrame:
    """Compile each robots.txt body into ``entries`` (array of
    struct<agents, rules, delay, is_default>) with a fold over its lines
    that follows the standard parser: a user-agent line after rules starts
    a new entry, a blank line ends one, rules before any user-agent are
    ignored, the first ``*`` entry is the default and further ``*`` entries
    are dropped.  One output row per origin.  A file that cannot be read as
    robots rules allows everything."""
    robots = robots.select(origin_col, _each(_plain_rules, "")(F.col(body_col)).alias(body_col))
    lines = f"split(coalesce({body_col}, ''), {q(_LINE_SPLIT)})"

    def parse(line):
        body = py_strip_sql(f"regexp_replace({line}, '#.*$', '')")

        def fields(b):
            key = py_strip_sql(f"substring_index({b}, ':', 1)")
            val = py_strip_sql(f"substr({b}, instr({b}, ':') + 1)")
            return struct(("blank", f"{line} = ''"),
                          ("key", f"CASE WHEN contains({b}, ':') THEN lower({key}) END"),
                          ("val", f"CASE WHEN contains({b}, ':') THEN {val} END"))
        return let(body, fields)
    parsed = f"transform({lines}, {lam(parse)})"
    zero = "named_struct('state', 0, 'entry', 0, 'rows', CAST(array() AS array<struct<entry:int,kind:string,val:string>>))"

    def step(acc, ln):
        st, en, rows = f"{acc}.state", f"{acc}.entry", f"{acc}.rows"

        def add(kind_sql, entry):
            return f"concat({rows}, array(named_struct('entry', {entry}, 'kind', {kind_sql}, 'val', {ln}.val)))"

        def nxt(state, entry, new_rows):
            return f"named_struct('state', {state}, 'entry', {entry}, 'rows', {new_rows})"
        ua_entry = f"CASE WHEN {st} = 2 THEN {en} + 1 ELSE {en} END"
        delay_rows = add(q("delay"), en)
        return (f"CASE WHEN {ln}.blank AND {st} > 0 THEN {nxt('0', f'{en} + 1', rows)} "
                f"WHEN {ln}.key = 'user-agent' THEN {nxt('1', ua_entry, add(q('agent'), ua_entry))} "
                f"WHEN {ln}.key IN ('allow', 'disallow') AND {st} != 0 THEN {nxt('2', en, add(f'{ln}.key', en))} "
                f"WHEN {ln}.key = 'crawl-delay' AND {st} != 0 THEN {nxt('2', en, delay_rows)} "
                f"WHEN {ln}.key = 'request-rate' AND {st} != 0 THEN {nxt('2', en, add(q('rate'), en))} "
                f"ELSE {acc} END")
    a, ln = fresh(), fresh()
    folded = f"aggregate({parsed}, {zero}, ({a}, {ln}) -> {step(a, ln)}).rows"
    staged = robots.select(F.col(origin_col).alias("origin"), expr(folded).alias("_rows"))
    return staged.select("origin", expr(_entries_sql("_rows")).alias("entries"))


def _entries_sql(rows: str) -> str:
    """Group fold rows into entries; keep entries that were closed with at
    least one rule or delay line; mark the first '*' entry as default."""
    def entries(ids):
        def one(e):
            mine = f"filter({rows}, r -> r.entry = {e})"
            return let(mine, lambda m: struct(
                ("entry", e),
                ("agents", f"transform(filter({m}, r -> r.kind = 'agent'), r -> r.val)"),
                ("rules", f"transform(filter({m}, r -> r.kind IN ('allow', 'disallow')), r -> named_struct("
                          f"'allow', r.kind = 'allow' OR r.val = '', 'path', r.val))"),
                ("delay", f"CAST(try_element_at(transform(filter({m}, r -> r.kind = 'delay' AND r.val RLIKE '^[0-9]+$'), "
                          f"r -> r.val), -1) AS INT)"),
                ("closed", f"exists({m}, r -> r.kind != 'agent')")))
        return f"filter(transform({ids}, {lam(one)}), x -> x.closed)"
    ids = f"array_distinct(transform({rows}, r -> r.entry))"

    def mark(es):
        e = fresh()
        first_star = f"try_element_at(filter({es}, {e} -> array_contains({e}.agents, '*')), 1).entry"
        return (f"filter(transform({es}, {e} -> named_struct('agents', {e}.agents, 'rules', {e}.rules, "
                f"'delay', {e}.delay, 'is_default', array_contains({e}.agents, '*'), 'entry', {e}.entry)), "
                f"x -> NOT x.is_default OR x.entry = {first_star})")
    return let(entries(ids), mark)


def _agent_token(agent: str) -> str:
    return agent.split("/")[0].lower()


def _matching_entry_sql(entries: str, agent: str) -> str:
    """First non-default entry naming the agent, else the default entry."""
    token = q(_agent_token(agent))
    e, a = fresh(), fresh()
    named = f"try_element_at(filter({entries}, {e} -> NOT {e}.is_default AND exists({e}.agents, {a} -> contains({token}, lower({a})))), 1)"
    default = f"try_element_at(filter({entries}, {e} -> {e}.is_default), 1)"
    return f"coalesce({named}, {default})"


def _url_path_sql(url: str) -> str:
    """path;params?query#fragment of the URL ('/' when empty)."""
    def build(p):
        s = (f"concat({p}.path, CASE WHEN {p}.params != '' THEN concat(';', {p}.params) ELSE '' END, "
             f"CASE WHEN {p}.query != '' THEN concat('?', {p}.query) ELSE '' END, "
             f"CASE WHEN {p}.fragment != '' THEN concat('#', {p}.fragment) ELSE '' END)")
        return f"CASE WHEN {s} = '' THEN '/' ELSE {s} END"
    return let(url_split_sql(url), build)


def robots_allowed_sql(entries: str, path: str, agent: str = ROBOTS_AGENT) -> str:
    """J1 verdict for the rule path of one URL against its host's compiled entries: first
    matching rule of the matching entry, in file order; no robots, no
    matching entry or no matching rule → allowed."""
    def decide(ent):
        r = fresh()
        rule = (f"try_element_at(filter({ent}.rules, {r} -> startswith({path}, {r}.path)), 1)")
        return f"coalesce({rule}.allow, true)"
    return f"coalesce({let(_matching_entry_sql(entries, agent), decide)}, true)"


def crawl_delay_sql(entries: str, agent: str = ROBOTS_AGENT) -> str:
    """Crawl-delay of the matching entry, else 1.0."""
    return f"coalesce(CAST({_matching_entry_sql(entries, agent)}.delay AS DOUBLE), {DEFAULT_CRAWL_DELAY})"


def origin_sql(url: str) -> str:
    """scheme://netloc of a URL (the robots.txt key)."""
    return let(url_split_sql(url), lambda p: f"concat({p}.scheme, '://', {p}.netloc)")


def robots_allowed(urls: DataFrame, robots: DataFrame, url_col: str = "url", agent: str = ROBOTS_AGENT,
                   broadcast: bool = False) -> DataFrame:
    """J1 + J2 for a table of URLs: adds ``allowed`` and ``crawl_delay``.

    ``robots(origin, body)`` holds one robots.txt per origin (absent or
    unfetchable = allow).  Only URLs with characters that quoting would
    change pass through Python for their path.  ``broadcast`` is for callers
    that have checked the number of origins."""
    compiled = compile_robots(robots)
    compiled = F.broadcast(compiled) if broadcast else compiled
    plain = F.col(f"`{url_col}`").rlike(r"^[A-Za-z0-9_.~/:-]*$")
    keyed = urls.withColumn("_origin", expr(origin_sql(f"`{url_col}`"))) \
        .withColumn("_odd_path", _each(_url_rule_path, None)(F.when(~plain, F.col(f"`{url_col}`")))) \
        .withColumn("_path", F.when(plain, expr(_url_path_sql(f"`{url_col}`"))).otherwise(F.col("_odd_path")))
    joined = keyed.join(compiled, keyed["_origin"] == compiled["origin"], "left").drop("origin")
    return joined.select(*urls.columns,
                         expr(robots_allowed_sql("entries", "_path", agent)).alias("allowed"),
                         expr(crawl_delay_sql("entries", agent)).alias("crawl_delay"))


# --------------------------------------------------------------------------
# J3 as-of robots snapshot

def robots_as_of(requests: DataFrame, snapshots: DataFrame, ttl_sec: int = ROBOTS_TTL_SEC) -> DataFrame:
    """For each request(host, ts, …) the newest snapshot(host, ts,
    snapshot_id) taken at or before it, used only while younger than the
    TTL (strictly).  Skew-safe as-of join: snapshots are copied into their
    own and the next TTL bucket, and the last-value window runs per
    (host, bucket), so no single host becomes one task."""
    bucket = f"CAST(floor(unix_micros(ts) / {ttl_sec * 1_000_000}) AS BIGINT)"
    req = requests.select("*", expr(bucket).alias("_bucket"), F.lit(1).alias("_is_req"),
                          F.lit(None).cast("timestamp").alias("_snap_ts"),
                          F.lit(None).cast("string").alias("_snap_id"))
    snap = snapshots.select("host", "ts", expr(f"explode(array({bucket}, {bucket} + 1))").alias("_bucket"),
                            F.lit(0).alias("_is_req"), F.col("ts").alias("_snap_ts"),
                            F.col("snapshot_id").cast("string").alias("_snap_id"))
    both = req.unionByName(snap, allowMissingColumns=True)
    w = Window.partitionBy("host", "_bucket").orderBy("ts", "_is_req").rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("_last", F.when(F.col("_is_req") == 0, F.struct("_snap_ts", "_snap_id"))) \
        .withColumn("_prev", F.last("_last", ignorenulls=True).over(w))
    fresh_ok = expr(f"_prev._snap_ts IS NOT NULL AND (unix_micros(ts) - unix_micros(_prev._snap_ts)) < {ttl_sec * 1_000_000}")
    out = marked.filter("_is_req = 1").select(
        *[c for c in requests.columns],
        F.when(fresh_ok, F.col("_prev._snap_id")).alias("snapshot_id"),
        F.when(fresh_ok, F.col("_prev._snap_ts")).alias("snapshot_ts"))
    return out


# --------------------------------------------------------------------------
# J5 / A5 keyword table

#: Keywords that become one array in the plan; longer lists are joined.
KEYWORDS_IN_PLAN = 2_000
#: Characters of the grams that index longer lists, and (gram, keyword) rows
#: that are broadcast.
GRAM, INDEX_AT_HAND = 4, 500_000


def keyword_first_match(texts: DataFrame, keywords: DataFrame, key_col: str, text_col: str,
                        word_boundary: bool = False, in_plan: int = KEYWORDS_IN_PLAN) -> DataFrame:
    """Table-driven keyword gate.  Each text row gets the first keyword of
    ``keywords(keyword, ord)`` (by ``ord``, then keyword) that is a substring (or
    whole word) of its lower-cased text (NULL when none), and the number of
    keywords found.  A NULL or empty keyword is none; one that is listed twice
    counts twice.

    A list of up to ``in_plan`` entries is one array in the plan, and the texts
    are neither joined nor moved.  A longer one is joined by an index of grams
    (``keyword_candidates``), however long it is; a text moves at most once, to
    meet the candidates of its key.  Where no keyword holds a blank, the distinct
    stretches between the blanks are looked up instead of the texts
    (``stretch_matches``)."""
    words = keywords.select(F.col("keyword").cast("string").alias("keyword"), F.coalesce(F.col("ord").cast("long"), F.lit((1 << 63) - 1)).alias("ord")) \
        .filter("keyword <> ''")                                     # a NULL place is the last
    lowered = texts.select(F.col(key_col).alias("_k"), F.lower(F.col(text_col)).alias("_t"))
    if words.limit(in_plan + 1).count() <= in_plan:
        rows = sorted((r.ord, r.keyword) for r in words.collect())
        listed = f"array({qlist([r[1] for r in rows])})" if rows else "CAST(array() AS array<string>)"
        k = fresh()
        hits = lowered.select("_k", expr(f"filter({listed}, {k} -> {_keyword_hit('_t', k, word_boundary)})").alias("_hits"))
    elif words.filter("contains(keyword, ' ')").isEmpty():
        return stretch_matches(lowered, words, word_boundary).withColumnRenamed("_k", key_col)
    else:
        found = keyword_candidates(lowered, words)
        k = fresh()
        # A text checks all candidates of its key, so rows that share one need no telling apart.
        both = lowered.join(found.withColumnRenamed("_k", "_of"), F.col("_k").eqNullSafe(F.col("_of")), "left")
        hits = both.select("_k", expr(f"transform(filter(coalesce(_found, CAST(array() AS array<struct<o:bigint,w:string>>)), "
                                      f"{k} -> {_keyword_hit('_t', f'{k}.w', word_boundary)}), {k} -> {k}.w)").alias("_hits"))
    return hits.select(F.col("_k").alias(key_col), expr("try_element_at(_hits, 1)").alias("first_keyword"),
                       F.greatest(F.size("_hits"), F.lit(0)).cast("long").alias("n_keywords"))


def _grams(text: str, size: int) -> str:
    """Distinct substrings of ``size`` characters.  Cut from an array of the
    characters, since seeking each in the string would walk there again."""
    c, i = fresh(), fresh()
    chars = f"split({text}, '')"
    body = let(chars, lambda x: f"array_distinct(transform(slice({x}, 1, greatest(size({x}) - {size - 1}, 0)), "
                                f"({c}, {i}) -> concat({', '.join(f'{x}[{i} + {j}]' for j in range(size))})))")
    return f"CASE WHEN length({text}) >= {size} THEN {body} END"


def stretch_matches(texts: DataFrame, words: DataFrame, word_boundary: bool) -> DataFrame:
    """``texts(_k, _t)`` and ``words(keyword, ord)``, none with a blank → per row
    ``_k``, ``first_keyword`` and ``n_keywords``.

    Such a keyword lies between two blanks, so it is searched in the distinct
    stretches between blanks of all texts, once in each: texts say the same words
    again and again, and long ones would have nearly every keyword for a
    candidate.  The rows then meet the numbers of the keywords in their stretches
    (listed in order, a repeat under a number of its own); the texts do not move,
    and a row keeps its first stretch whether it holds any or not."""
    listed = staged(words.orderBy("ord", "keyword").withColumn("id", F.monotonically_increasing_id()), "keyword-places")
    rows = texts.withColumn("_row", F.monotonically_increasing_id())          # numbered before they are split
    said = rows.select("_k", "_row", expr("posexplode_outer(array_distinct(split(_t, ' ')))").alias("_pos", "_s"))
    vocabulary = staged(said.select("_s").filter("_s <> ''").distinct(), "stretches")
    found = keyword_candidates(vocabulary.select(F.col("_s").alias("_k"), F.col("_s").alias("_t")), listed.groupBy("keyword").agg(F.min("ord").alias("ord"))) \
        .select(F.col("_k").alias("_s"), F.explode("_found.w").alias("keyword")).filter(expr(_keyword_hit("_s", "keyword", word_boundary)))
    found = staged(found.join(listed, "keyword").groupBy("_s").agg(F.collect_list("id").alias("_ids")), "stretch-hits")
    near = F.broadcast if found.agg(F.coalesce(F.sum(F.size("_ids")), F.lit(0))).first()[0] <= INDEX_AT_HAND else (lambda df: df)
    both = said.join(near(found), "_s", "left").filter("_ids IS NOT NULL OR coalesce(_pos, 0) = 0")
    per_row = both.groupBy("_row", "_k").agg(F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids")) \
        .select("_k", F.array_min("_ids").alias("id"), F.size("_ids").cast("long").alias("n_keywords"))
    return per_row.join(listed, "id", "left").select("_k", F.col("keyword").alias("first_keyword"), "n_keywords")


def keyword_candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts(_k, _t)`` and ``words(keyword, ord)`` → per key the keywords that
    its texts may hold (``_found``: structs of ord and keyword, in order).

    Grams have GRAM characters; shorter keywords are grams themselves.  How many
    texts hold a gram is counted for the grams that keywords have; each keyword
    is indexed under its rarest one only, and the grams of the texts are joined
    with that index.  No text is carried along, and none meets a keyword whose
    rarest gram it lacks."""
    sizes = [r[0] for r in words.select(F.least(F.length("keyword"), F.lit(GRAM))).distinct().collect()]   # GRAM values at most
    kw = staged(words, "keyword-list")
    gram = " ".join(f"WHEN length(keyword) {'>=' if n == GRAM else '='} {n} THEN {_grams('keyword', n)}" for n in sorted(sizes))
    of_words = staged(kw.select("keyword").distinct().select("keyword", expr(f"explode(CASE {gram} END)").alias("gram")), "keyword-grams")
    distinct = of_words.select("gram").distinct()
    small = of_words.count() <= INDEX_AT_HAND
    near = F.broadcast if small else (lambda df: df)
    every = ", ".join(f"coalesce({_grams('_t', n)}, CAST(array() AS array<string>))" for n in sizes)
    held = texts.select("_k", expr(f"explode(concat({every}))").alias("gram"))
    held = staged(held.join(near(distinct), "gram", "left_semi"), "keyword-texts")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_words.join(counts, "gram", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r"))
    index = staged(rarest.filter("r.n > 0").select("keyword", F.col("r.gram").alias("gram")).join(kw, "keyword"), "keyword-index")
    pairs = held.join(near(index), "gram").select("_k", F.struct(F.col("ord").alias("o"), F.col("keyword").alias("w")).alias("x"))
    # Rows of one key may bring a keyword twice; a listed repeat is kept (by the number of times it is listed).
    times = kw.groupBy("keyword", "ord").agg(F.count(F.lit(1)).alias("times")) \
        .select(F.struct(F.col("ord").alias("o"), F.col("keyword").alias("w")).alias("x"), "times").filter("times > 1")
    once = pairs.distinct()
    if not times.isEmpty():
        once = once.join(times, "x", "left").withColumn("x", F.explode(F.array_repeat("x", F.coalesce("times", F.lit(1)).cast("int"))))
    return once.groupBy("_k").agg(F.sort_array(F.collect_list("x")).alias("_found"))
