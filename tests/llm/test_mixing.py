"""op 10: targets by plain capping, taken words by the order of the keys."""
import collections
import random

from webloom.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and left * w[s] / free > most * sizes[s] + 1e-9} if free else set()
        if not above:
            return {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        capped |= above


def run(docs_of, rows, **more):
    return M.mix(docs_of(rows), **more).collect()


def test_targets_and_epochs(docs_of):
    rng = random.Random(2)
    names = ["a", "b", "ä", "z", None, "tiny"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(names[:5])) for i in range(600)]
    rows += [(1000 + i, "w " * 3, "en", "tiny") for i in range(3)] + [(None, None, None, None), (None, "x y", "en", None)]
    out = run(docs_of, rows, rows_per_bucket=25)
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = targets(dict(sizes))
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        epochs = int(want[r.source] // sizes[r.source])
        assert epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, run(docs_of, rows, rows_per_bucket=400)), key=str)


def test_hot_source_repeated_rows_whole_boundary(docs_of):
    rows = [(7, "a b c", "en", "hot")] * 300 + [(i, "d e f g", "en", "cold") for i in range(50)]
    out = run(docs_of, rows, boundary="whole", rows_per_bucket=10)
    assert all(r.taken % r.size == 0 for r in out)
    for s in ("hot", "cold"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4


def test_empty_and_wordless(docs_of):
    assert run(docs_of, []) == []
    out = run(docs_of, [(1, "", "en", "a"), (2, None, "en", "b")])
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_words_are_counted_like_a_pattern(docs_of, long_text):
    texts = ["", " ", "a", " a ", "a b", "\x1ca \x85", "a\tb\x0bc\nd", long_text]
    got = docs_of(list(enumerate(texts))).selectExpr("doc_id", f"{M.size_sql()} AS words").collect()
    import re
    assert {r.doc_id: r.words for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}


def test_heavier_quality_comes_first(docs_of):
    good = [(i, f"plain words of document number {i}", "en", "s") for i in range(300)]
    bad = [(1000 + i, f"| # | * | {i} |", "en", "s") for i in range(300)]
    out = run(docs_of, good + bad + [(5000, "w " * 1200, "en", "a")])
    share = lambda lo, hi: sum(r.taken > 0 for r in out if lo <= r.doc_id < hi)
    assert share(0, 300) > 1.5 * share(1000, 1300) or out[0].target >= out[0].source_size
