"""Long keyword lists by the gram index, against the list in the plan."""
import random

import pytest

from webloom.operators.gates import keyword_first_match

TEXTS = [(1, "We improve things, humanities"), (2, None), (3, ""), (4, "Ünïcode 😀 und mehr"), (5, "aaaaab"), (5, "prove it"), (None, "human")]
WORDS = [("prove", 2), ("human", 1), ("humanities", 3), ("😀 u", 4), ("ü", 9), ("aab", 5), ("aa", 5), ("", 0), (None, 1), ("b", None), ("human", 1),
         ("absent", 0), ("it", 7)]


@pytest.mark.parametrize("boundary", [False, True])
def test_index_equals_list(spark, boundary):
    texts = spark.createDataFrame(TEXTS, "page_id long, text string")
    words = spark.createDataFrame(WORDS, "keyword string, ord int")
    got = [sorted(map(str, keyword_first_match(texts, words, "page_id", "text", boundary, in_plan=n).collect())) for n in (0, 100)]
    assert got[0] == got[1] and len(got[0]) == len(TEXTS)
    if not boundary:
        assert "Row(page_id=1, first_keyword='human', n_keywords=5)" in got[0]


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 11)))
    words = list({word() for _ in range(102_000)})[:100_000]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.05 else word() for _ in range(60))) for i in range(300)]
    kw = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord int")
    out = {r.page_id: r for r in keyword_first_match(spark.createDataFrame(rows, "page_id long, text string"), kw, "page_id", "text").collect()}
    place = {w: i for i, w in enumerate(words)}
    for i, text in rows[:60]:
        hits = {text[a:b] for a in range(len(text)) for b in range(a + 4, min(a + 11, len(text) + 1))} & place.keys()
        assert out[i].n_keywords == len(hits) and out[i].first_keyword == min(hits, key=place.get, default=None)


def test_a_long_text_searches_a_repeated_word_once(spark, monkeypatch):
    """Keywords without a blank are looked up in the distinct words of all texts
    (before, every text was searched for each of its candidates)."""
    from webloom.operators import gates as G

    seen = []
    inner = G.keyword_candidates
    monkeypatch.setattr(G, "keyword_candidates", lambda texts, words: seen.append(texts.count()) or inner(texts, words))
    words = [f"word{i}" for i in range(40)]
    texts = [(i % 30, " ".join(words[(i + j * j) % 40] for j in range(500))) for i in range(60)] + [(7, ""), (None, "  word3,word39  "), (8, None)]
    kw = spark.createDataFrame([("word3", 2), ("ord39", 1), ("word1", 5), ("word1", 5)], "keyword string, ord int")
    got = G.keyword_first_match(spark.createDataFrame(texts, "id long, t string"), kw, "id", "t", in_plan=0).collect()
    assert seen == [41]                                             # 40 words and one stretch of two
    listed = [("ord39", 1), ("word3", 2), ("word1", 5), ("word1", 5)]
    want = []
    for key, text in texts:
        hits = [w for w, _ in listed if text and w in text]
        want.append((key, hits[0] if hits else None, len(hits)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
