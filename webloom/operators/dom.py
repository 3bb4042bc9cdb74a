"""H0 — parse each page once into a flat DOM (the only Python stage).

``parse_dom(pages)`` runs the standard-library ``html.parser`` tokenizer in
an Arrow-batched ``mapInArrow`` task and emits, per page, a compact
relational picture of the tree:

* ``dom.text``  — every text node that ``get_text()`` would return,
  concatenated in document order (script/style/template text, comments and
  declarations excluded);
* ``dom.strip_length`` — summed length of the stripped text nodes;
* ``dom.nodes`` — elements in document (pre-)order:
  ``struct<i, tag, parent, depth, t0, t1, last, attrs>``.  ``[t0, t1)`` is
  the element's span of the UTF-8 bytes of ``dom.text`` (a subtree's text is
  contiguous; bytes, because seeking a character means walking the string),
  and ``nodes[i+1 .. last]`` is its subtree.

Everything downstream — title, main-content choice, headings, links, forms,
captcha selectors — is a native Spark expression over these arrays (see
``operators/extract.py``).  Python only tokenizes.

Tree rules (the documented behaviour of the tree builder the page tables
were produced with, on top of ``html.parser``): void elements close at
once; there are no implied end tags (an unclosed ``<p>`` contains the
following ones); an end tag pops to the nearest open element of that name
and is ignored if none is open; a redundant end tag of an already-closed
void element is swallowed once; whitespace-only text outside ``pre`` /
``textarea`` collapses to one newline or space; numeric references below
256 decode as windows-1252; unknown named references are kept as
``&name`` (without the semicolon).
"""

from __future__ import annotations

import html.entities
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Void elements closed as soon as they open, elements whose
# strings are not page text, and whitespace-preserving elements.
VOID_ELEMENTS = frozenset([
    'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'keygen', 'link', 'menuitem',
    'meta', 'param', 'source', 'track', 'wbr',
    'basefont', 'bgsound', 'command', 'frame', 'image', 'isindex', 'nextid', 'spacer',
])
NON_TEXT_CONTAINERS = frozenset(['script', 'style', 'template'])
PRESERVE_WS = frozenset(['pre', 'textarea'])
ASCII_SPACES = '\x20\x0a\x09\x0c\x0d'

_ASCII_SPACE_TABLE = {ord(c): None for c in ASCII_SPACES}
_ENTITIES = html.entities.html5

NODE_TYPE = T.StructType([
    T.StructField("i", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
DOM_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("strip_length", T.IntegerType()),
    T.StructField("nodes", T.ArrayType(NODE_TYPE)),
    T.StructField("error", T.StringType()),
])


class _Tokens(HTMLParser):
    """The document as a list of tokens: ``(kind, value, attributes)``."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple] = []

    def _token(self, kind, value="", attributes=()):
        self.found.append((kind, value, attributes))

    def handle_data(self, data):
        self._token("text", data)

    def handle_charref(self, name):
        self._token("text", _character(int(name.lstrip("xX"), 16 if name[0] in "xX" else 10)))

    def handle_entityref(self, name):
        self._token("text", _ENTITIES.get(f"{name};") or _ENTITIES.get(name) or f"&{name}")

    def handle_starttag(self, tag, attrs):
        self._token("open", tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._token("both", tag, attrs)

    def handle_endtag(self, tag):
        self._token("close", tag)

    def handle_comment(self, data):
        self._token("break")

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._token("break")
        if data[:6].upper() == "CDATA[":
            self._token("text", data[6:])
            self._token("break")


def _character(code: int) -> str:
    """A numeric reference: below 256 as in windows-1252 where that has the
    code, surrogates and codes that do not exist as U+FFFD."""
    if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return "\N{REPLACEMENT CHARACTER}"
    if code < 256:
        known = bytes((code,)).decode("windows-1252", "ignore")
        return known or chr(code)
    return chr(code)


def parse_html(doc: str):
    """One document → (text, length of its stripped strings, nodes).  A node is
    ``[tag, parent, depth, t0, t1, last, attributes]``.

    A fold over the tokens: what stands between two pieces of markup is one
    string (white space alone shrinks to a line feed or a blank, except where
    it is kept); an end tag closes up to the nearest open element of its name
    and is nothing if there is none; a void element is closed as it opens, and
    one later end tag of its name belongs to it."""
    tokens = _Tokens()
    tokens.feed(doc)
    tokens.close()
    text, nodes, length, stripped = [], [], 0, 0
    path: list[int] = []                # open elements
    strings: list[str] = []             # of the string being read
    owed: list[str] = []                # void elements whose end tag may follow
    names: Counter[str] = Counter()     # of the open elements
    inside = dict.fromkeys(("hidden", "kept"), 0)
    kinds = (("hidden", NON_TEXT_CONTAINERS), ("kept", PRESERVE_WS))

    def end_string():
        nonlocal length, stripped
        if strings:
            value = "".join(strings)
            strings.clear()
            if not inside["kept"] and not value.translate(_ASCII_SPACE_TABLE):
                value = "\n" if "\n" in value else " "
            if not inside["hidden"]:
                text.append(value)
                length += len(value) if value.isascii() else len(value.encode())
                stripped += len(value.strip())

    def enter(tag, attributes):
        nodes.append([tag, path[-1] if path else -1, len(path), length, length, len(nodes),
                      {k: v or "" for k, v in attributes}])
        path.append(len(nodes) - 1)
        names[tag] += 1
        for name, tags in kinds:
            inside[name] += tag in tags

    def leave(depth):
        while len(path) > depth:
            node = nodes[path.pop()]
            node[4], node[5] = length, len(nodes) - 1
            names[node[0]] -= 1
            for name, tags in kinds:
                inside[name] -= node[0] in tags

    def close(tag):
        if names[tag]:
            leave(next(d for d in range(len(path) - 1, -1, -1) if nodes[path[d]][0] == tag))

    for kind, value, attributes in tokens.found:
        if kind == "text":
            strings.append(value)
        elif kind == "close" and value in owed:
            owed.remove(value)          # ends nothing, not even the string
        else:
            end_string()
            if kind in ("open", "both"):
                enter(value, attributes)
            if kind == "close":
                close(value)
            elif kind == "both":
                if value in owed:
                    owed.remove(value)
                else:
                    close(value)
            elif kind == "open" and value in VOID_ELEMENTS:
                close(value)
                owed.append(value)
    end_string()
    leave(0)
    return "".join(text), stripped, nodes


_NODE_ARROW = pa.struct([
    ("i", pa.int32()), ("tag", pa.string()), ("parent", pa.int32()), ("depth", pa.int32()),
    ("t0", pa.int32()), ("t1", pa.int32()), ("last", pa.int32()),
    ("attrs", pa.map_(pa.string(), pa.string())),
])
_DOM_ARROW = pa.struct([
    ("text", pa.string()), ("strip_length", pa.int32()),
    ("nodes", pa.list_(_NODE_ARROW)), ("error", pa.string()),
])


def _dom_column(docs, tags=None) -> pa.Array:
    """Build the ``dom`` struct column for one Arrow batch, column-wise."""
    texts, errors, valid = [], [], []
    stripped, node_off = [], [0]
    n_i, n_tag, n_parent, n_depth, n_t0, n_t1, n_last = [], [], [], [], [], [], []
    attr_off, a_keys, a_vals = [0], [], []
    for doc in docs:
        if doc is None:
            texts.append(None); errors.append(None); valid.append(False)
            stripped.append(None); node_off.append(len(n_i))
            continue
        try:
            text, strip_length, nodes = parse_html(doc)
            if tags is not None:
                nodes = [n for n in nodes if n[0] in tags]
            err = None
        except Exception as e:  # a page that cannot be parsed yields no DOM
            text, strip_length, nodes, err = None, 0, [], f"{type(e).__name__}: {e}"
        texts.append(text); errors.append(err); valid.append(True)
        stripped.append(strip_length)
        for i, (tag, parent, depth, t0, t1, last, amap) in enumerate(nodes):
            n_i.append(i); n_tag.append(tag); n_parent.append(parent); n_depth.append(depth)
            n_t0.append(t0); n_t1.append(t1); n_last.append(last)
            a_keys.extend(amap.keys()); a_vals.extend(amap.values()); attr_off.append(len(a_keys))
        node_off.append(len(n_i))
    attrs = pa.MapArray.from_arrays(pa.array(attr_off, pa.int32()), pa.array(a_keys, pa.string()),
                                    pa.array(a_vals, pa.string()))
    node_struct = pa.StructArray.from_arrays(
        [pa.array(n_i, pa.int32()), pa.array(n_tag, pa.string()), pa.array(n_parent, pa.int32()),
         pa.array(n_depth, pa.int32()), pa.array(n_t0, pa.int32()), pa.array(n_t1, pa.int32()),
         pa.array(n_last, pa.int32()), attrs],
        fields=list(_NODE_ARROW))
    nodes_arr = pa.ListArray.from_arrays(pa.array(node_off, pa.int32()), node_struct)
    mask = pa.array([not v for v in valid], pa.bool_())
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(stripped, pa.int32()), nodes_arr, pa.array(errors, pa.string())],
        fields=list(_DOM_ARROW), mask=mask)


BATCH_BYTES = 1 << 20


def _slices(docs: pa.Array):
    """(start, length) of consecutive rows of about BATCH_BYTES of markup."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(docs), 0).to_pylist()):
        if i > start and size + n > BATCH_BYTES:
            yield start, i - start
            start, size = i, 0
        size += n
    yield start, len(docs) - start


def parse_dom(pages: DataFrame, html_col: str = "html", keep_html: bool = False,
              tags: frozenset[str] | None = None) -> DataFrame:
    """H0: add a ``dom`` column parsed from ``html_col``.

    ``tags`` names the elements that will be read on their own (without
    their descendants): the others are not sent back from Python.  A batch
    is decoded and built for about a megabyte of markup at a time, whatever the
    session's Arrow batch size.

    All other columns pass through unchanged.  The HTML column itself is
    dropped by default so it is not shipped back from Python; compute any
    raw-markup features before this stage.  A page whose markup raises in
    the tokenizer gets ``dom.error`` set instead of failing the job."""
    out_fields = [f for f in pages.schema.fields if keep_html or f.name != html_col]
    out_schema = T.StructType(out_fields + [T.StructField("dom", DOM_TYPE)])
    keep = [f.name for f in out_fields]

    def run(batches):
        for rb in batches:
            for at, n in _slices(rb.column(html_col)):
                part = rb.slice(at, n)
                cols = [part.column(name) for name in keep] + [_dom_column(part.column(html_col).to_pylist(), tags)]
                yield pa.RecordBatch.from_arrays(cols, names=keep + ["dom"])

    return pages.mapInArrow(run, out_schema)
