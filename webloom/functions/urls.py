"""URL scalars (F3-F5) and URL predicates (P3, P4, P6-P9) as Spark SQL.

Splitting and joining follow the semantics of Python's ``urllib.parse``
(``urlsplit``/``urlparse``/``urljoin``/``urlunsplit``), which is what the
page tables were produced with, but are written with Spark built-ins only:
``regexp_extract`` for the RFC 3986 split and ``aggregate`` over the path
segments for dot-segment folding.  Nothing here leaves the JVM.

``parse_url`` is deliberately not used: it throws under ANSI mode and
returns NULL for URLs Python accepts.
"""

from __future__ import annotations

from pyspark.sql import Column

from .core import arg, expr, let, q, qlist, struct
from .text import C0_OR_SPACE, PY_WS, py_strip_sql

# ---------------------------------------------------------------------------
# Fixed values (Python urllib.parse scheme tables, used verbatim).
USES_RELATIVE = ['', 'ftp', 'http', 'gopher', 'nntp', 'imap',
                 'wais', 'file', 'https', 'shttp', 'mms',
                 'prospero', 'rtsp', 'rtsps', 'rtspu', 'sftp',
                 'svn', 'svn+ssh', 'ws', 'wss']
USES_NETLOC = ['', 'ftp', 'http', 'gopher', 'nntp', 'telnet',
               'imap', 'wais', 'file', 'mms', 'https', 'shttp',
               'snews', 'prospero', 'rtsp', 'rtsps', 'rtspu', 'rsync',
               'svn', 'svn+ssh', 'sftp', 'nfs', 'git', 'git+ssh',
               'ws', 'wss', 'itms-services']
USES_PARAMS = ['', 'ftp', 'hdl', 'prospero', 'http', 'imap',
               'https', 'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip',
               'sips', 'mms', 'sftp', 'tel']

# Pseudo-link prefixes dropped from link lists (case-insensitive).
PSEUDO_PREFIXES = ['javascript:', 'mailto:', 'tel:', 'data:', 'ftp:', 'file:']

# Request-URL screening patterns (searched anywhere,
# case-insensitive) and private-host patterns (anchored on the hostname).
SUSPICIOUS_PATTERNS = [
    r'localhost',
    r'127\.0\.0\.1',
    r'192\.168\.',
    r'10\.',
    r'172\.1[6-9]\.',
    r'172\.2[0-9]\.',
    r'172\.3[0-1]\.',
    r'file://',
    r'ftp://',
    r'javascript:',
    r'data:',
    r'mailto:',
    r'tel:',
]
PRIVATE_HOST_PATTERNS = [
    r'^localhost$',
    r'^127\.0\.0\.1$',
    r'^192\.168\.',
    r'^10\.',
    r'^172\.1[6-9]\.',
    r'^172\.2[0-9]\.',
    r'^172\.3[0-1]\.',
    r'^169\.254\.',
    r'^::1$',
    r'^fc00:',
    r'^fe80:',
]
SCRAPING_TYPES = ['static', 'dynamic', 'auto']
# ---------------------------------------------------------------------------

_URL_RE = r'(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'
_PARAMS_RE = r'(?s)^(.*/)?([^/;]*);([^/]*)$'
_PSEUDO_RE = "^(?:\\#|" + "|".join(PSEUDO_PREFIXES) + ")"


# IPv6 as written between brackets: eight groups, or fewer around one "::", the
# last two groups perhaps as IPv4; a zone may follow.
_H = "[0-9A-Fa-f]{1,4}"
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TAIL = f"(?:{_H}:{_H}|{_V4})"
_IPV6 = "(?:" + "|".join(
    [f"(?:{_H}:){{6}}{_TAIL}", f"::(?:{_H}:){{5}}{_TAIL}"]
    + [f"(?:(?:{_H}:){{0,{k}}}{_H})?::(?:{_H}:){{{4 - k}}}{_TAIL}" for k in range(5)]
    + [f"(?:(?:{_H}:){{0,5}}{_H})?::{_H}", f"(?:(?:{_H}:){{0,6}}{_H})?::"]) + ")(?:%[^%]+)?"
_BRACKETED = rf"(?s)^(?:.*@)?\[(?:{_IPV6}|v[0-9A-Fa-f]+\..+)\](?::.*)?$"


def bracketed_ok_sql(netloc: str) -> str:
    """False where Python raises: unbalanced brackets, or brackets around
    anything but an IPv6 (or future) address, or text beside them."""
    return (f"(NOT contains({netloc}, '[') AND NOT contains({netloc}, ']')) "
            f"OR (contains({netloc}, '[') AND contains({netloc}, ']') AND {netloc} RLIKE {q(_BRACKETED)})")


def url_split_sql(u: str, default_scheme: str | None = None) -> str:
    """``urlparse`` as struct<scheme, netloc, path, params, query, fragment, ok>.

    Leading C0-control-or-space is stripped and tab/CR/LF removed first, as
    Python does.  ``ok`` is false where Python raises (a bracketed host
    that is no address)."""
    pre = f"regexp_replace(regexp_replace(coalesce({u}, ''), {q('^' + C0_OR_SPACE + '+')}, ''), {q('[\\t\\r\\n]')}, '')"
    R = q(_URL_RE)

    def split5(p):
        found = f"lower(regexp_extract({p}, {R}, 1))"
        scheme = found if default_scheme is None else \
            let(found, lambda f: f"CASE WHEN {f} != '' THEN {f} ELSE {default_scheme} END")
        return struct(("scheme", scheme), ("netloc", f"regexp_extract({p}, {R}, 2)"),
                      ("path", f"regexp_extract({p}, {R}, 3)"), ("query", f"regexp_extract({p}, {R}, 4)"),
                      ("fragment", f"regexp_extract({p}, {R}, 5)"))

    def with_params(s):
        P = q(_PARAMS_RE)
        has = f"({s}.scheme IN ({qlist(USES_PARAMS)}) AND {s}.path RLIKE {P})"
        n = f"{s}.netloc"
        return struct(
            ("scheme", f"{s}.scheme"), ("netloc", n),
            ("path", f"CASE WHEN {has} THEN concat(regexp_extract({s}.path, {P}, 1), regexp_extract({s}.path, {P}, 2)) ELSE {s}.path END"),
            ("params", f"CASE WHEN {has} THEN regexp_extract({s}.path, {P}, 3) ELSE '' END"),
            ("query", f"{s}.query"), ("fragment", f"{s}.fragment"),
            ("ok", bracketed_ok_sql(n)))

    return let(let(pre, split5), with_params)


def netloc_host_sql(netloc: str) -> str:
    """``SplitResult.hostname`` from a netloc: after the last '@', bracketed
    IPv6 or up to the first ':', lower-cased (zone id kept); NULL if empty."""
    hostinfo = f"regexp_extract({netloc}, {q('(?s)([^@]*)$')}, 1)"

    def host_of(h):
        return (f"CASE WHEN contains({h}, '[') THEN regexp_extract({h}, {q('(?s)\\[([^\\]]*)')}, 1) "
                f"ELSE regexp_extract({h}, {q('(?s)^([^:]*)')}, 1) END")

    def lowered(h):
        return (f"CASE WHEN {h} = '' THEN CAST(NULL AS STRING) WHEN contains({h}, '%') THEN "
                f"concat(lower(substring_index({h}, '%', 1)), '%', regexp_extract({h}, {q('(?s)%(.*)$')}, 1)) "
                f"ELSE lower({h}) END")
    return let(let(hostinfo, host_of), lowered)


def _unsplit_sql(scheme, netloc, path, query, fragment) -> str:
    """``urlunsplit``; each component evaluated once."""
    def build(c):
        s, n, p, qy, f = (f"{c}.s", f"{c}.n", f"{c}.p", f"{c}.q", f"{c}.f")
        body = (f"CASE WHEN {n} != '' THEN concat('//', {n}, CASE WHEN {p} != '' AND NOT startswith({p}, '/') "
                f"THEN concat('/', {p}) ELSE {p} END) "
                f"WHEN startswith({p}, '//') THEN concat('//', {p}) "
                f"WHEN {s} != '' AND {s} IN ({qlist(USES_NETLOC)}) AND ({p} = '' OR startswith({p}, '/')) "
                f"THEN concat('//', {p}) ELSE {p} END")
        return (f"concat(CASE WHEN {s} != '' THEN concat({s}, ':') ELSE '' END, {body}, "
                f"CASE WHEN {qy} != '' THEN concat('?', {qy}) ELSE '' END, "
                f"CASE WHEN {f} != '' THEN concat('#', {f}) ELSE '' END)")
    return let(struct(("s", scheme), ("n", netloc), ("p", path), ("q", query), ("f", fragment)), build)


def _unparse_sql(scheme, netloc, path, params, query, fragment) -> str:
    full = f"concat({path}, CASE WHEN {params} != '' THEN concat(';', {params}) ELSE '' END)"
    return _unsplit_sql(scheme, netloc, full, query, fragment)


def _fold_dots_sql(segs: str) -> str:
    """RFC 3986 dot-segment removal the way urljoin does it."""
    folded = (f"aggregate({segs}, CAST(array() AS array<string>), (acc, sg) -> CASE WHEN sg = '..' "
              f"THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN sg = '.' THEN acc "
              f"ELSE concat(acc, array(sg)) END)")
    tailed = f"CASE WHEN element_at({segs}, -1) IN ('.', '..') THEN concat({folded}, array('')) ELSE {folded} END"
    return let(f"array_join({tailed}, '/')", lambda j: f"CASE WHEN {j} = '' THEN '/' ELSE {j} END")


def _relative_segments_sql(bpath: str, path: str) -> str:
    dirs = let(f"split({bpath}, '/')",
               lambda d: f"CASE WHEN element_at({d}, -1) != '' THEN slice({d}, 1, greatest(size({d}) - 1, 0)) ELSE {d} END")

    def squeeze(r):
        return (f"CASE WHEN size({r}) >= 2 THEN concat(slice({r}, 1, 1), "
                f"filter(slice({r}, 2, greatest(size({r}) - 2, 0)), x -> x != ''), slice({r}, -1, 1)) ELSE {r} END")
    rel = let(f"concat({dirs}, split({path}, '/'))", squeeze)
    return f"CASE WHEN startswith({path}, '/') THEN split({path}, '/') ELSE {rel} END"


def url_join_parts_sql(base: str, b: str, href: str) -> str:
    """F3 with a pre-split base ``b`` (``url_split_sql(base)``), so a page's
    base URL is split once and reused for all of its links."""
    return f"{url_join_facts_sql(base, b, href)}.url"


def url_join_facts_sql(base: str, b: str, href: str) -> str:
    """F3 and what follows from the same split: struct<url, ok, is_external>,
    ``ok`` as of the href and ``is_external`` (F5) of the joined url."""
    def resolve(u, url):
        no_path = f"({u}.path = '' AND {u}.params = '')"
        has_net = f"({u}.netloc != '')"
        query = f"CASE WHEN NOT {has_net} AND {no_path} AND {u}.query = '' THEN {b}.query ELSE {u}.query END"
        folded = let(_relative_segments_sql(f"{b}.path", f"{u}.path"), _fold_dots_sql)
        path = f"CASE WHEN {has_net} THEN {u}.path WHEN {no_path} THEN {b}.path ELSE {folded} END"
        params = f"CASE WHEN {has_net} THEN {u}.params WHEN {no_path} THEN {b}.params ELSE {u}.params END"
        netloc = f"CASE WHEN {has_net} THEN {u}.netloc ELSE {b}.netloc END"
        own = f"({u}.scheme != {b}.scheme OR {u}.scheme NOT IN ({qlist(USES_RELATIVE)}))"
        joined = (f"CASE WHEN {own} THEN {url} "
                  f"ELSE {_unparse_sql(f'{u}.scheme', netloc, path, params, query, f'{u}.fragment')} END")
        return own, joined, netloc

    def run(c):
        bs, url = f"{c}.b", f"{c}.u"

        def facts(u):
            own, joined, netloc = resolve(u, url)
            where = f"CASE WHEN {bs} = '' OR ({url} != '' AND {own}) THEN {u}.netloc WHEN {url} = '' THEN {b}.netloc ELSE {netloc} END"
            return struct(("url", f"CASE WHEN {bs} = '' THEN {url} WHEN {url} = '' THEN {bs} ELSE {joined} END"),
                          ("ok", f"{u}.ok"),
                          ("is_external", f"(NOT ({u}.ok AND {b}.ok) OR {where} != {b}.netloc)"))
        return let(url_split_sql(url, default_scheme=f"{b}.scheme"), facts)
    return let(struct(("b", f"coalesce({base}, '')"), ("u", f"coalesce({href}, '')")), run)


def url_join_sql(base: str, href: str) -> str:
    """``urllib.parse.urljoin(base, href)``."""
    return let(url_split_sql(base), lambda b: url_join_parts_sql(base, b, href))


def is_external_parts_sql(link: str, b: str) -> str:
    """F5 with a pre-split base: netloc(link) != netloc(base); a URL that
    fails to parse counts as external."""
    return let(url_split_sql(link), lambda p: f"(NOT ({p}.ok AND {b}.ok) OR {p}.netloc != {b}.netloc)")


def is_external_sql(link: str, base: str) -> str:
    return let(url_split_sql(base), lambda b: is_external_parts_sql(link, b))


def has_pseudo_prefix_sql(u: str) -> str:
    return f"coalesce(lower({u}) RLIKE {q(_PSEUDO_RE)}, false)"


def _valid_parts(s: str, p: str) -> str:
    return (f"({s} != '' AND NOT {has_pseudo_prefix_sql(s)} AND NOT ({s} RLIKE {q(PY_WS)}) "
            f"AND {p}.scheme IN ('http', 'https') AND {p}.netloc != '' AND {p}.ok)")


def is_valid_url_sql(u: str) -> str:
    """Trimmed non-empty, not a fragment or pseudo link, no whitespace
    anywhere, http(s) scheme and a network location."""
    return f"coalesce({let(py_strip_sql(u), lambda s: let(url_split_sql(s), lambda p: _valid_parts(s, p)))}, false)"


def valid_external_sql(u: str, b: str) -> str:
    """P3 and F5 from one split: true or false (is_external) for a valid URL,
    NULL for any other."""
    def check(s):
        return let(url_split_sql(s), lambda p: f"CASE WHEN {_valid_parts(s, p)} THEN NOT {b}.ok OR {p}.netloc != {b}.netloc END")
    return let(py_strip_sql(u), check)


def skip_pseudo_link_sql(u: str) -> str:
    """True for links dropped before resolution (empty after strip, or a
    fragment/pseudo-scheme link)."""
    return let(py_strip_sql(f"coalesce({u}, '')"), lambda s: f"({s} = '' OR {has_pseudo_prefix_sql(s)})")


def is_scrapable_url_sql(u: str) -> str:
    """Syntactic request check; the netloc must be [A-Za-z0-9.-]+ so
    ports and user:pass are rejected."""
    def check(s):
        parsed = let(url_split_sql(s), lambda p: (f"({p}.ok AND {p}.scheme IN ('http', 'https') AND {p}.netloc != '' "
                                                  f"AND {p}.netloc RLIKE '^[a-zA-Z0-9.-]+$')"))
        return f"({s} != '' AND {parsed})"
    return f"coalesce({let(py_strip_sql(u), check)}, false)"


def is_suspicious_url_sql(u: str) -> str:
    """Any screening pattern found anywhere in the URL."""
    return f"coalesce({u} RLIKE {q('(?i)(?:' + '|'.join(SUSPICIOUS_PATTERNS) + ')')}, false)"


def is_private_url_sql(u: str) -> str:
    """Missing hostname, a parse error, or a private/loopback host."""
    pat = q("(?i)(?:" + "|".join(PRIVATE_HOST_PATTERNS) + ")")

    def check(p):
        return let(netloc_host_sql(f"{p}.netloc"),
                   lambda h: f"(NOT {p}.ok OR {h} IS NULL OR {h} RLIKE {pat})")
    return f"coalesce({let(url_split_sql(u), check)}, true)"


def validate_request_sql(u: str, scraping_type: str) -> str:
    """Ordered request checks → struct<valid, message, warnings>."""
    def build(c):
        bad_url, bad_type, private, susp = f"{c}.bad_url", f"{c}.bad_type", f"{c}.private", f"{c}.susp"
        msg = (f"CASE WHEN {bad_url} THEN 'Invalid URL format' "
               f"WHEN {bad_type} THEN 'Invalid scraping type. Must be static, dynamic, or auto' "
               f"WHEN {private} THEN 'Cannot scrape private or localhost URLs' ELSE '' END")
        warn = (f"CASE WHEN NOT {bad_url} AND NOT {bad_type} AND {susp} "
                f"THEN array('URL appears suspicious. Please verify it is legitimate.') "
                f"ELSE CAST(array() AS array<string>) END")
        return let(msg, lambda m: struct(("valid", f"{m} = ''"), ("message", m), ("warnings", warn)))
    facts = struct(("bad_url", f"NOT {is_scrapable_url_sql(u)}"),
                   ("bad_type", f"NOT coalesce({scraping_type} IN ({qlist(SCRAPING_TYPES)}), false)"),
                   ("private", is_private_url_sql(u)), ("susp", is_suspicious_url_sql(u)))
    return let(facts, build)


# Column wrappers ---------------------------------------------------------

def url_split(u) -> Column:
    return expr(url_split_sql(arg(u)))


def url_scheme(u) -> Column:
    """lower-cased scheme, '' when absent."""
    return expr(f"{url_split_sql(arg(u))}.scheme")


def url_netloc(u) -> Column:
    """network location as written (case, port and userinfo kept)."""
    return expr(f"{url_split_sql(arg(u))}.netloc")


def url_host(u) -> Column:
    """``urlparse(u).hostname``."""
    return expr(netloc_host_sql(f"{url_split_sql(arg(u))}.netloc"))


def url_join(base, href) -> Column:
    return expr(url_join_sql(arg(base), arg(href)))


def is_external(link, base) -> Column:
    return expr(is_external_sql(arg(link), arg(base)))


def is_valid_url(u) -> Column:
    return expr(is_valid_url_sql(arg(u)))


def skip_pseudo_link(u) -> Column:
    return expr(skip_pseudo_link_sql(arg(u)))


def is_scrapable_url(u) -> Column:
    return expr(is_scrapable_url_sql(arg(u)))


def is_suspicious_url(u) -> Column:
    return expr(is_suspicious_url_sql(arg(u)))


def is_private_url(u) -> Column:
    return expr(is_private_url_sql(arg(u)))


def validate_request(u, scraping_type) -> Column:
    return expr(validate_request_sql(arg(u), arg(scraping_type)))
