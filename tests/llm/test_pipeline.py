"""The pipeline: each stage against a plain version on what the one before kept."""
import collections
import re

import corpus_pipeline as P
import pytest

from test_jaccard_join import brute as components
from test_mixing import targets
from test_suffix_dedup import brute as stripped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in P.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return [d.collect() for d in docs]


def test_stages_and_columns(steps, spark):
    columns = list(spark.read.parquet(f"{SF}/documents.parquet").columns)
    assert 4 <= len(P.STAGES) <= 5 and all(list(rows[0].asDict()) == columns for rows in steps[:-1])


def test_language_keeps_clean_documents(steps):
    kept = {r.doc_id for r in steps[1]}
    lettered = [r for r in steps[0] if sum(c.isalpha() for c in r.text or "") > 40]
    assert sum(r.doc_id in kept for r in lettered) >= 0.99 * len(lettered)
    assert all(re.search(r"[^\W\d_]", r.text) for r in steps[1])


def test_one_document_of_each_group(steps):
    want = components([(r.doc_id, r.text) for r in steps[1]], 5, 80)
    assert sorted(r.doc_id for r in steps[2]) == sorted(i for i, n, c in want if n == 0 or c == i)


def test_one_row_of_each_group_with_null_and_repeated_ids(docs_of, spark):
    base = lambda k: [f"w{k}x{i}" for i in range(60)]
    text = lambda k, *more: " ".join([*base(k), *more])
    rows = [(1, text(1)), (2, text(1, "a")), (2, text(2)),              # id 2: a near copy and a text of its own
            (3, text(3)), (None, text(3, "b")), (None, text(4)),        # a null id loses, unless it is alone
            (5, text(5)), (5, text(5, "c")), (5, text(5, "d")),         # near texts of one id
            (None, text(6)), (None, text(6, "e")),                      # a group of null ids
            (7, text(7)), (7, text(7)), (8, text(8)), (8, text(9)),     # equal rows; two groups of one id
            (9, text(8, "f")), (9, None), (9, None), (None, "")]
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs_of(rows).select(*P.COLUMNS), SF).collect()]
    group = lambda t: t and t.split()[0]
    assert sorted(((i, group(t)) for i, t in got), key=str) == sorted(
        [(1, "w1x0"), (2, "w2x0"), (3, "w3x0"), (None, "w4x0"), (5, "w5x0"), (None, "w6x0"), (7, "w7x0"), (8, "w8x0"), (8, "w9x0"),
         (9, None), (9, None), (None, "")], key=str)


def test_repeats_are_gone(steps):
    want = {i: b.decode(errors="ignore") for i, _, _, _, b in stripped([(r.doc_id, r.text) for r in steps[2]])}
    got = {r.doc_id: r.text for r in steps[3]}
    for i, text in want.items():
        if text.strip():
            assert got[i].encode()[:50] == text.encode()[:50] and abs(len(got[i]) - len(text)) < 9


def test_mixture_near_targets(steps):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    longest = collections.Counter()
    for r in steps[3]:
        sizes[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for r in steps[4]:
        taken[r.source] += words(r.text)
    for s, goal in targets(dict(sizes)).items():
        assert abs(taken[s] - goal) <= longest[s] / 2 + 1
    assert max(collections.Counter(r.doc_id for r in steps[4]).values()) <= 3


def test_ids(steps):
    assert sorted(r.doc_id for r in steps[5]) == sorted(r.doc_id for r in steps[4])
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in steps[5])


def test_odd_documents(docs_of, spark):
    text = "the house and the water of the old town are good for them " * 3
    rows = [(1, None), (2, ""), (3, "12 34"), (4, text), (4, text), (5, text), (None, text + "x"), (6, text * 40)]
    rows += [(10 + i, f"the {i} words of this short text are for number {i} and not {i * 7} of the others") for i in range(30)]
    docs = docs_of(rows).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
    assert docs.count() > 20
    empty = docs_of([]).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_columns_with_clashing_names_are_left_at_the_door(docs_of, spark):
    text = "the house and the water of the old town are good for them and their children in the light "
    rows = [(i, text + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(6)] + [(7, text + " ".join(f"w1x{j}" for j in range(39)))]
    docs = docs_of(rows).selectExpr("*", "1 AS id", "'k' AS k", "2 AS words", "3 AS copies", "'s' AS s", "0 AS component", "'t' AS text_key")
    for name, stage in P.STAGES:
        plain, more = (sorted(map(str, stage(spark, d, SF).collect())) for d in (docs.select(*P.COLUMNS), docs))
        assert plain == more, name
