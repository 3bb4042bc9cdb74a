"""op 8: planted articles come back whole, boilerplate does not."""
import random
import re
from html import escape, unescape

import pytest

from webloom.llm import html_main as H

WORDS = "river stone quiet morning, under the old bridge, people walk and talk of the long winter".split()


def prose(rng, low=20, high=60):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) + "."


BOILERPLATE = [
    '<nav><ul><li><a href="/a">Home page of this site</a></li><li><a href="/b">More, more, and more</a></li></ul></nav>',
    "<header><h1>Site name</h1><p>{0}</p></header>", "<footer>&copy; site, {0}</footer>",
    '<aside class="sidebar"><p>{0}</p></aside>', '<div class="ad">{0}</div>', '<div id="cookie-notice"><p>{0}</p></div>',
    '<section id="comments"><div class="comment"><p>{0}</p></div><div class="comment"><p>{0}</p></div></section>',
    "<form><label>{0}</label><input name=x><button>Send</button></form>", "<script>var a = '<p>{0}</p>';</script>",
    "<style>p {{ color: red }}</style>", '<div style="display: none"><p>{0}</p></div>', "<!-- <p>{0}</p> -->",
    '<div class="menu"><a href="/x">{0}</a></div>', '<ul class="breadcrumbs"><li>{0}</li></ul>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<div>{}</div>"])
def test_planted_article(wrap):
    rng = random.Random(8)
    for _ in range(25):
        blocks = [prose(rng) for _ in range(rng.randint(3, 6))] + [rng.choice(["Of.", "Short & sweet", "a < b"])]
        rng.shuffle(blocks)
        inner = "<h2>Chapter & verse</h2>" + "".join(f"<p>{escape(b)}</p>\n" for b in blocks)
        around = [b.format(prose(rng)) for b in rng.sample(BOILERPLATE, 6)]
        page = f"<html><head><title>T</title></head><body>{''.join(around[:3])}{wrap.format(inner)}{''.join(around[3:])}</body></html>"
        assert H.main_text(page) == "\n\n".join(["Chapter & verse", *blocks])


LONG = "".join(f"<p>{prose(random.Random(k), 40, 60)}</p>" for k in range(14))
LONG_TEXT = [prose(random.Random(k), 40, 60) for k in range(14)]
LEAD = "A short lead of one sentence, no more."


@pytest.mark.parametrize("body", ['<div class="content">{}</div>', "<div>{}</div>", "<section>{}</section>"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
def test_title_lists_and_short_parts_beside_the_body(wrap, body):
    inner = (f"<h1>Title</h1><div>{LEAD}</div><p>Brief.</p>{body.format(LONG)}<h2>More</h2><ul><li>one</li><li><a href=x>two</a></li></ul>"
             f"<table><tr><td>cell</td></tr></table><section><p>{LEAD}</p></section>")
    page = f"<body><nav>menu</nav><div>Site line</div>{wrap.format(inner)}<div class='related'><p>{prose(random.Random(9))}</p></div></body>"
    assert H.main_text(page) == "\n\n".join(["Title", LEAD, "Brief.", *LONG_TEXT, "More", "one", "two", "cell", LEAD])


def test_several_sections_and_a_title_outside_the_article():
    parts = "".join(f"<section><h2>Part {k}</h2><div class='text'>{LONG if k == 1 else f'<p>{LEAD}</p>'}</div></section>" for k in range(3))
    want = ["Part 0", LEAD, "Part 1", *LONG_TEXT, "Part 2", LEAD]
    assert H.main_text(f"<body><article>{parts}</article></body>") == "\n\n".join(want)
    links = "<ul><li><a href=a>Another page here</a></li><li><a href=b>And one more page</a></li></ul>"
    page = f"<body><main><h1><a href=t>Title</a></h1><p>{LEAD}</p><article>{parts}</article>{links}</main></body>"
    assert H.main_text(page) == "\n\n".join(["Title", LEAD, *want])


def test_containers_without_an_article_element():
    page = f"<body><div><div><h1>Title</h1><div>{LEAD}</div><div class='content'>{LONG}</div></div></div><div>Site line</div></body>"
    assert H.main_text(page) == "\n\n".join(["Title", LEAD, *LONG_TEXT])
    short = prose(random.Random(3), 20, 25)
    page = f"<body><section>{LONG}</section><section><p>{short}</p></section><div>Site line</div></body>"
    assert H.main_text(page) == "\n\n".join([*LONG_TEXT, short])


def test_white_space_references_and_open_paragraphs():
    page = ("<body><article><h1>A&amp;B &#233;&eacute;&nbsp;x</h1><p><b>one, two,\n three<br>four <p>five\t<i>six</i></p>"
            "<ul><li>seven<li>eight</ul></article></body>")
    assert H.main_text(page) == "A&B éé x\n\none, two, three four\n\nfive six\n\nseven\n\neight"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<!-- x", "<script>x", "<a b='", "<", "</", "<>", "<p", "&#xD800;"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(H.main_text(page), str)


def test_plain_text_and_nesting():
    assert H.main_text("just words") == "just words"
    assert H.main_text("<div>" * 50_000 + "deep text") == "deep text"
    assert H.main_text("<p>" + "<p x=\"" * 20_000) is not None


KEPT = ['<p class="byline">{}</p>', '<div class="meta">{}</div>', '<div class="toc">{}</div>', '<p class="legal">{}</p>',
        '<div class="market-share">{}</div>', '<div id="side-effects">{}</div>', '<section id="related-work"><p>{}</p></section>']
LOST = ['<div class="related-posts"><a href=x>{}</a></div>', '<div class="ad">{}</div>', '<section id="comments"><p>{}</p></section>',
        '<div class="comment-list"><p>{}</p></div>', '<ul class="toc"><li><a href="#a">{}</a></li></ul>', '<div class="share">{}</div>']


@pytest.mark.parametrize("wrap", ["article", "main"])
def test_names_inside_an_article(wrap):
    text = prose(random.Random(4))
    for part, stays in [(x, True) for x in KEPT] + [(x, False) for x in LOST]:
        page = f"<body><{wrap}><h1>Title</h1>{LONG}{part.format(text)}</{wrap}></body>"
        assert H.main_text(page) == "\n\n".join(["Title", *LONG_TEXT, *([text] if stays else [])]), part


def test_formulas_and_references_across_tags():
    page = "<article><p>Let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> hold.</p><p>A &<b>lt;</b> B &amp;lt; 1 < 2 AT&T</p></article>"
    assert H.main_text(page) == "Let x<2 hold.\n\nA &lt; B &lt; 1 < 2 AT&T"


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "</span2>" * n, lambda n: "<ul><li>" + "<div>" * n + "<li>" * n,
                                  lambda n: "<table>" + "<thead>" * n + "<td>" * n, lambda n: "<p x='\"><p y=\"'>" * n, lambda n: "<p>" * n + "</p>" * n,
                                  lambda n: "<a <b" * n, lambda n: "<b x='" * n + ">"])
def test_broken_pages_take_linear_time(make):
    import time

    def seconds(n):
        t = time.process_time()
        H.main_text("<body>" + make(n) + "end of text")
        return time.process_time() - t
    n = 1_000_000 // len(make(1))
    seconds(n // 8)
    assert seconds(n) < 20 * max(0.1, seconds(n // 8))


def test_table(spark):
    page = "<nav>x</nav><article><p>" + "text, and more text, " * 9 + "</p></article>"
    rows = [(1, "u", page), (None, None, None), (2, "v", ""), (1, "u", page), (2**60 + 1, "w", page * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    out = {(r.page_id, r.url): r for r in H.extract(df).collect()}
    assert out[1, "u"].text.startswith("text, and") and out[1, "u"].n_chars == len(out[1, "u"].text)
    assert out[None, None].text == "" and out[2, "v"].n_chars == 0 and (2**60 + 1, "w") in out
    assert H.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The articles of the given pages, cut out by their own tags."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows)).collect()}
    for r in rows:
        inner = re.sub(r"<br>", " ", re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
