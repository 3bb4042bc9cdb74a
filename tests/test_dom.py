"""Tree rules of the parse stage (documented in operators/dom.py)."""
from webloom.operators.dom import parse_html


def nodes_by_tag(nodes, tag):
    return [n for n in nodes if n[0] == tag]


def text_of(text, node):
    return text[node[3]:node[4]]


def test_unclosed_p_contains_following():
    text, _, nodes = parse_html("<body><p>AAAAAAAAAAAA<p>BBBBBBBBBBBB</p></body>")
    ps = nodes_by_tag(nodes, "p")
    assert text_of(text, ps[0]) == "AAAAAAAAAAAABBBBBBBBBBBB"
    assert text_of(text, ps[1]) == "BBBBBBBBBBBB"


def test_nested_list_item_in_both_lists():
    text, _, nodes = parse_html("<ul><li>x<ul><li>y</li></ul></li></ul>")
    lis = nodes_by_tag(nodes, "li")
    assert [text_of(text, li) for li in lis] == ["xy", "y"]


def test_script_style_comment_not_text_and_cdata_end_tag():
    text, _, nodes = parse_html('<head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>'
                                '<body><!-- c --><p>a</p></body>')
    assert text == "Ta"
    assert len(nodes_by_tag(nodes, "p")) == 1


def test_entities_decoded_once():
    text, _, _ = parse_html("<p>&amp;lt; &copy;&#150;&bogus; x</p>")
    assert text == "&lt; ©–&bogus x"


def test_void_and_redundant_end_tags():
    text, _, nodes = parse_html("<div><br></br><br/>z<img src=a></div>")
    assert text == "z"
    assert [n[0] for n in nodes] == ["div", "br", "br", "img"]
    assert nodes[0][5] == 3  # subtree of div ends at the img


def test_end_tag_without_open_element_ignored():
    text, _, nodes = parse_html("<div>a</span>b</div>")
    assert text == "ab" and nodes[0][4] == 2


def test_whitespace_only_text_collapses():
    text, _, _ = parse_html("<ul>\n   <li>a</li>  <li>b</li></ul><pre>  \n </pre>")
    assert text == "\na b  \n "
