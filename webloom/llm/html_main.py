"""Main text of HTML pages by tree scoring.

Each page becomes a small tree.  A paragraph (a block of text of its own)
earns points for its length and its commas; the points go to its parent in
full, to the parent above by half, further up by a third, a quarter and so on.
A container's points are discounted by its link density.  The best container
wins.  If it lies in an article (or main) element, that whole element is chosen,
and of a main around the article all but lists of links; without such an element
the choice rises to every container that holds little text besides.  Siblings of
the choice stay if they scored a fair share or read like prose.  What lies in
boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, hidden parts, reader comments) is cut first.  Inside an article or main,
a name alone cuts only where it is the whole class or id (or comments and
adverts); other names that merely hold such a word (market-share, side-effects,
byline, toc) cut only what is mostly links.  All blocks of what is kept are
returned, however short.

Defined results: null or empty html, or a page without text, gives the empty
text.  Rows are independent; only the three named columns are read.  Nesting,
length and broken markup are unbounded: one forward pass whose time is linear in
the page, no recursion; after a quote that never closes, tags end at the next
``>``.  Character references are decoded piece by piece, so markup between two
pieces never makes a reference.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes annotation annotation-xml".split())
#: Elements that never hold main text.
CUT = frozenset("head script style title noscript template iframe noembed noframes object canvas svg audio video "
                "nav footer aside form button select option textarea input label fieldset dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mo mn ms mtext mspace "
                   "mstyle mpadded mphantom mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced "
                   "menclose merror mtable mtr mtd mlabeledtr maction".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of the same kind, up to its container.
ENDS_OWN = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
            "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
            "thead": ("tr td th", "table"), "tbody": ("thead tr td th", "table"), "tfoot": ("tbody tr td th", "table")}
ENDS_OWN = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS_OWN.items()}

_NAMES = ("ad|ads|advert|advertisement|advertising|adbox|adunit|adsense|sponsor|sponsored|promo|promotion|banner|"
          "sidebar|side|rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|topbar|toolbar|"
          "header|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|"
          "subscription|signup|login|paywall|share|sharing|social|related|recommended|recommendations|trending|"
          "comment|comments|commentlist|disqus|reply|replies|respond|pagination|pager|widget|skip|sitemap|copyright|"
          "legal|disclaimer|tags|taglist|byline|meta|toc")
#: Class and id names of boilerplate: a whole word of the name, in any case.
BOILERPLATE = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:s?\d*)(?=$|[\s_-])", re.I)
#: Names that cut inside an article too: whole classes or ids, and those of
#: comments and adverts however they go on.
_WEAK = "byline|meta|toc|legal|disclaimer|copyright|tags|taglist|side|rail|header|masthead|related|share|notice|alert"
PLAIN_NAMES = frozenset(_NAMES.split("|")) - frozenset(_WEAK.split("|")) | frozenset(("related", "share", "notice"))
SURE = re.compile(r"(?:comments?|commentlist|disqus|advert\w*|ads?|cookies?|newsletter)(?:$|[_-].*)", re.I)
#: Share of a part's text in links from which a boilerplate word in its name cuts it.
MOSTLY_LINKS = 0.5
#: Names that speak for a container, whatever else they say.
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|page|blog)(?=$|[\s_-])", re.I)
ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|menu|menubar|dialog|alert|alertdialog|form|"
                   r"toolbar", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Points of a container before any paragraph (its kind) and for its name.
KIND_POINTS = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
               "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "address": -3.0, "th": -5.0}
NAME_POINTS = 25.0
MIN_PARAGRAPH = 25
SIBLING_SHARE, MIN_SIBLING = 0.2, 10.0
#: Share of a container's text, links aside, from which the choice rises to it.
NEARLY_ALL = 0.9


class _Page:
    """The tree of one page as parallel lists; node 0 is the root."""

    def __init__(self) -> None:
        self.tag, self.parent, self.cut, self.bonus = ["#root"], [-1], [False], [0.0]
        self.doubtful: list[int] = []                  # cut if they are mostly links
        self.blocks: list[tuple[int, str, int]] = []   # (node, text, characters in links)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _judge(tag: str, source: str, parent_tag: str, in_article: bool) -> tuple[bool, bool, float]:
    """Whether an element is boilerplate, whether it is if it is mostly links,
    and the points its name earns."""
    if tag in CUT:
        return True, False, 0.0
    cut, doubtful = tag == "header" and parent_tag not in ("article", "main", "section"), False
    if not source:
        return cut, False, KIND_POINTS.get(tag, 0.0)
    has = _attributes(source)
    names = f"{has.get('class', '')} {has.get('id', '')}"
    speaks = bool(CONTENT.search(names)) or has.get("role", "").lower() in ("main", "article")
    cut = (cut or "hidden" in has or has.get("aria-hidden", "").lower() == "true"
           or bool(HIDDEN.search(has.get("style", ""))) or bool(ROLES.fullmatch(has.get("role", "").strip())))
    if tag not in ("html", "body", "article", "main") and BOILERPLATE.search(names):
        if in_article:
            cut = cut or any(x.lower() in PLAIN_NAMES or SURE.fullmatch(x) for x in names.split())
            doubtful = not cut
        else:
            own = CONTENT.sub(" ", names)
            cut = cut or not speaks or bool(re.search(r"comment|sidebar|footer|menu|advert|cookie|related|share|promo",
                                                      own, re.I))
    return cut, doubtful, KIND_POINTS.get(tag, 0.0) + NAME_POINTS * speaks


def _parse(html: str) -> _Page:
    page = _Page()
    stack = [0]                     # open elements that are not inline
    places: dict[str, list[int]] = {}   # where in the stack each tag is open
    links = cut_depth = 0           # open <a>, open elements that are cut
    text: list[str] = []
    linked: list[str] = []
    lower, loose = None, False

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                inside = len(" ".join("".join(linked).split())) if linked else 0
                page.blocks.append((stack[-1], words, min(inside, len(words))))
            text.clear()
            linked.clear()

    def close_to(depth: int) -> None:
        nonlocal cut_depth
        flush()
        while len(stack) > depth:
            node = stack.pop()
            places[page.tag[node]].pop()
            cut_depth -= page.cut[node]

    def deepest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not cut_depth:
            piece = unescape(html[at:lt])
            text.append(piece)
            if links:
                linked.append(piece)
        if lt >= size:
            break
        nxt = html[lt + 1:lt + 2]
        if nxt == "!":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        if nxt == "?":
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if name is None:
            if closing:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:                                   # a bare "<" is text
                if not cut_depth:
                    text.append("<")
                at = lt + 1
            continue
        over = None if loose else _TAG_END.match(html, name.end())
        loose = over is None
        end = over.end() if over else (html.find(">", name.end()) + 1 or size)
        tag = name[0].lower()
        at = end
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and not places.get("p"):
                flush()
            elif tag not in INLINE and tag not in VOID and places.get(tag):
                close_to(places[tag][-1])
            continue
        source = html[name.end():end - 1]
        if tag in INLINE:
            if tag == "br":
                if not cut_depth:
                    text.append(" ")
            elif tag == "a" and not source.endswith("/"):
                links = 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ENDS_P and "p" in (page.tag[n] for n in stack[-3:]):
            close_to(places["p"][-1])
        elif tag in ENDS_OWN:
            same, bounds = ENDS_OWN[tag]
            if (bound := deepest(bounds)) < deepest(same):          # the lowest of its kind in this container
                close_to(min(x[bisect_right(x, bound)] for t in same if (x := places.get(t)) and x[-1] > bound))
        if tag in RAW:
            if lower is None:
                lower = html.lower()
                if len(lower) != size:              # a few characters change length
                    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), html)
            stop = lower.find(f"</{tag}", at)
            gt = html.find(">", stop) if stop >= 0 else -1
            at = gt + 1 if gt >= 0 else size
            continue
        flush()
        cut, doubtful, bonus = _judge(tag, source, page.tag[stack[-1]], bool(places.get("article") or places.get("main")))
        if doubtful:
            page.doubtful.append(len(page.tag))
        page.tag.append(tag)
        page.parent.append(stack[-1])
        page.cut.append(cut)
        page.bonus.append(bonus)
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(page.tag) - 1)
        cut_depth += cut
        if tag in ("td", "th", "li"):
            links = 0
    flush()
    return page


def _without_links(page: _Page) -> _Page:
    """The page without the doubtful parts that are mostly links."""
    if page.doubtful:
        chars, linked = [0] * len(page.tag), [0] * len(page.tag)
        for node, words, inside in page.blocks:
            chars[node] += len(words)
            linked[node] += inside
        for node in range(len(page.tag) - 1, 0, -1):
            chars[page.parent[node]] += chars[node]
            linked[page.parent[node]] += linked[node]
        gone = [False] * len(page.tag)
        for node in page.doubtful:
            gone[node] = linked[node] >= MOSTLY_LINKS * chars[node]
        for node in range(1, len(page.tag)):
            gone[node] = gone[node] or gone[page.parent[node]]
        page.blocks = [b for b in page.blocks if not gone[b[0]]]
    return page


def _best(page: _Page) -> tuple[set[int], set[int]]:
    """The chosen container and the siblings that are kept, and what is left
    out again inside them."""
    n = len(page.tag)
    score: dict[int, float] = {}
    chars, linked = [0] * n, [0] * n
    for node, words, inside in page.blocks:
        chars[node] += len(words)
        linked[node] += inside
        if len(words) < MIN_PARAGRAPH or page.tag[node] in HEADINGS:
            continue
        points = 1.0 + words.count(",") + min(len(words) / 100.0, 3.0)
        points *= 1.0 - inside / len(words)
        # A paragraph element passes its points on; a container with text of its own keeps them.
        up, level = (page.parent[node] if page.tag[node] == "p" else node), 1
        while up >= 0 and level <= 5:
            score[up] = score.get(up, page.bonus[up]) + points / level
            up, level = page.parent[up], level + 1
    for node in range(n - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        linked[page.parent[node]] += linked[node]
    for node in range(n):                 # a short article is still the article
        if page.tag[node] in ("article", "main") and chars[node]:
            score.setdefault(node, page.bonus[node])
    if not score:
        return {0}, set()
    density = lambda x: linked[x] / chars[x] if chars[x] else 0.0
    total = {x: s * (1.0 - density(x)) for x, s in score.items()}
    best = max(total, key=lambda x: (total[x], -x))
    if not best:
        return {0}, set()
    least = max(MIN_SIBLING, SIBLING_SHARE * total[best])
    children: dict[int, list[int]] = {}
    for node in range(1, n):
        children.setdefault(page.parent[node], []).append(node)

    def siblings(of: int, marked: bool) -> set[int]:
        found = set()
        for node in children[page.parent[of]]:
            if node != of and page.tag[node] != "body":
                prose = (page.tag[node] == "p" or (not marked and node in score)) and density(node) < 0.25
                if total.get(node, 0.0) >= least or (prose and chars[node] > 80):
                    found.add(node)
        return found

    above = [best]
    while page.parent[above[-1]] > 0:
        above.append(page.parent[above[-1]])
    articles = [x for x in above if page.tag[x] == "article"]
    mains = [x for x in above if page.tag[x] == "main"]
    core = top = articles[-1] if articles else mains[-1] if mains else best
    if articles or mains:
        top = min((core, *mains[-1:]))      # ancestors come first in the page
    else:
        solid = lambda x: chars[x] - linked[x]
        while (up := page.parent[top]) > 0 and page.tag[up] not in ("html", "body"):
            if sum(map(solid, {top, *siblings(top, False)})) < NEARLY_ALL * solid(up):
                break
            top = up
    # Between the core and what it rose to, lists of links are not text.
    path = above[above.index(core):above.index(top) + 1]
    within = set(path)
    out = {x for up in path[1:] for x in children[up] if x not in within and density(x) >= 0.5
           and page.tag[x] not in HEADINGS and page.tag[x] != "header"}
    return {top, *siblings(top, bool(articles or mains))}, out


def main_text(html: str | None) -> str:
    """Blocks of the main text of one page, joined by an empty line."""
    if not html:
        return ""
    page = _without_links(_parse(html))
    keep, out = _best(page)
    inside = [x in keep for x in range(len(page.tag))]
    for node in range(1, len(page.tag)):
        inside[node] = node not in out and (inside[node] or inside[page.parent[node]])
    in_header = [t == "header" for t in page.tag]
    for node in range(1, len(page.tag)):
        in_header[node] = in_header[node] or in_header[page.parent[node]]
    return "\n\n".join(words for node, words, _ in page.blocks
                       if inside[node] and (not in_header[node] or page.tag[node] in HEADINGS))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts],
                                                 names=["page_id", "url", "text"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return (rows.mapInArrow(lean(run), "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
