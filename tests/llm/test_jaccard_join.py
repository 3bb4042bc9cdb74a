"""op 1: sizes and components against all pairs."""
import collections
import random
import re

import pytest

from webloom.llm import jaccard_join as J


def brute(rows, width=4, threshold=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for k in range(len(rows)):
        ids[find(k)].append(rows[k][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in range(len(rows))]


def run(docs_of, rows, **more):
    return [tuple(r) for r in J.jaccard_join(docs_of(rows), **more).select("doc_id", "n_shingles", "component_id").collect()]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return words


@pytest.mark.parametrize("width, threshold", [(4, 85), (5, 80)])
def test_components_equal_all_pairs(docs_of, width, threshold):
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(12):           # chains and stars of near copies, sharing a common passage
        base = [f"g{g}w{i}" for i in range(rng.randint(40, 160))] + passage
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.5:
                base = edited(rng, base, 1)
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))[rng.choice([0, 0, 5]):]))
    rows += [" ".join(passage + [f"u{i}x{k}" for k in range(5)]) for i in range(25)]
    rows = [(100 + i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    assert sorted(run(docs_of, rows, width=width, threshold=threshold)) == sorted(brute(rows, width, threshold))


def test_odd_rows(docs_of, long_text):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a"), (7, "a b c d"), (8, "a b c d"), (8, "a b c d"),
            (None, "a b c d"), (None, None), (9, "é É x y"), (10, "É é x y"), (11, long_text), (12, long_text + " end"),
            (13, "a\x1cb c d")]
    assert sorted(run(docs_of, rows), key=str) == sorted(brute(rows), key=str)
    assert run(docs_of, []) == []


def test_hot_group_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "BROADCAST_IDS", 3)      # the way by a join
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2])))) for i in range(120)] + [(500 + i, "same words here now") for i in range(60)]
    assert sorted(run(docs_of, rows)) == sorted(brute(rows))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("x", "y")], ["a", "b"])
    assert {r.key: r.component for r in J.components(edges).collect()} == {**{f"{i:04d}": "0000" for i in range(61)}, "x": "x", "y": "x"}


def test_short_text_is_one_shingle():
    assert len(J.shingles(b"a b c", 4)) == 1 and len(J.shingles(b"", 4)) == 0
    assert (J.shingles(b"A b C d", 4) == J.shingles(b"a\tb c\nd", 4)).all()
    assert len(J.shingles(b"a a a a a a", 4)) == 1


def test_sets_of_the_first_round_are_dropped_before_the_second(spark, monkeypatch):
    import os
    from webloom.llm import jaccard_join as J
    from webloom.session import ensure_checkpoint_dir

    where = ensure_checkpoint_dir(spark)
    kept = lambda: {f for f in os.listdir(where) if f.startswith(("jaccard-sets", "jaccard-pairs"))}
    before, seen, inner = kept(), [], J.components
    monkeypatch.setattr(J, "components", lambda *a: seen.append(kept() - before) or inner(*a))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, "other words stand here alone")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert seen and seen[0] == set()                                # before: the sets stayed to the end
