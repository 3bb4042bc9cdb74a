"""Branch and bound against scoring every document, and the odd cases."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from webloom.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def bag(text):
    return Counter(t.translate(UPPER) for t in TERM.findall(text or ""))


def plain(docs, items, k=10):
    bags = [(d, b, sum(b.values())) for d, b in ((d, bag(t)) for d, t in docs) if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for doc_id, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t, q in bag(text).items() if b[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.selectExpr("*", "1 AS number", "2 AS doc_id", "'x' AS tids", "0 AS salt")


def words(rng, n, most=400):
    return " ".join(f"w{int(most * rng.random() ** 3)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randrange(1, 200))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]                          # a hot group of equal texts
    docs += [(2000 + i, docs[9][1] + f" w{i}") for i in range(100)]
    docs += [(3000, None), (3001, ""), (3002, " .,;\n"), (None, docs[7][1]), (7, docs[7][1]), (3003, "ÉCOLE École école, x_y A-B")]
    items = [(i, words(rng, rng.randrange(1, 30))) for i in range(40)]
    items += [(90, docs[7][1]), (91, None), (92, "..."), (93, "unheardof"), (94, "École a b"), (1, "W1 w1 W2"), (1, "W1 w1 W2"),
              (None, "w3")]
    return docs, items


@pytest.mark.parametrize("block, item_terms", [(S.BLOCK_ENTRIES, S.ITEM_TERMS), (2_000, 40)])
def test_equals_scoring_every_document(spark, docs_of, monkeypatch, block, item_terms):
    docs, items = corpus()
    monkeypatch.setattr(S, "BLOCK_ENTRIES", block)
    got = S.rank(docs_of(docs).repartition(3), items_of(spark, items), item_terms=item_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_tree_nodes_are_the_branching_prefixes_and_bound_their_documents():
    rng, rows = random.Random(3), []
    for i in range(400):
        places = np.array(sorted({int(60 * rng.random() ** 2) for _ in range(rng.randrange(1, 12))}))
        rows.append((places.astype(">u4").tobytes(), i, rng.randrange(1, 50), places, np.array([rng.randrange(1, 9) for _ in places])))
    tree = S.Tree(rows)
    assert tree.root == (0, 400)
    seen, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        places, most, m = tree.summary(node)
        inside = [tree.rows[i] for i in range(*node)]
        assert m == min(r[2] for r in inside)
        want = Counter()
        for r in inside:
            for p, t in zip(r[3], r[4], strict=True):
                want[int(p)] = max(want[int(p)], int(t))
        assert dict(zip(places.tolist(), most.tolist(), strict=True)) == want
        if node[1] - node[0] == 1:
            seen.append(node[0])
            continue
        kids = sorted(tree.kids(node))
        assert [k[0] for k in kids] == [node[0], *(k[1] for k in kids[:-1])] and kids[-1][1] == node[1]
        todo += kids
    assert sorted(seen) == list(range(400))


def test_search_leaves_subtrees():
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        places = np.array(sorted({int(300 * rng.random() ** 2) for _ in range(20)}))
        rows.append((places.astype(">u4").tobytes(), i, 100, places, np.ones(len(places), dtype=np.int64)))
    items = S.Items(np.arange(1), np.array([290, 291, 295]), np.ones(3, dtype=np.int64), np.array([0]))
    search, calls = S.Search(items, np.arange(1, 301) * 10, 10), []
    real = search.bounds
    search.bounds = lambda *a: calls.append(1) or real(*a)
    search.tree(S.Tree(rows))
    assert len(search.heaps[0]) == 10 and len(calls) < 1500


def test_very_long_text_is_read_whole(spark, docs_of, long_text, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1000)
    docs = [(1, long_text + " needle"), (2, "needle " + "x" * 300_000), (3, "hay")]
    items = [(1, "Needle w5x7"), (2, "x" * 300_000)]
    assert sorted(map(tuple, S.rank(docs_of(docs), items_of(spark, items)).collect()), key=str) == plain(docs, items)


def test_empty_tables(spark, docs_of):
    docs, items = [(1, "a")], [(1, "a")]
    assert S.rank(docs_of(docs).limit(0), items_of(spark, items)).collect() == []
    assert S.rank(docs_of(docs), items_of(spark, items).limit(0)).collect() == []
