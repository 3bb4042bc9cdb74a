"""ops 3 and 4: held-out accuracy, folds that teach nothing, odd rows, plain versions."""
import math
import random
import zlib

import numpy as np
import pytest

from webloom.llm import language_id as L
from webloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"
VOCABULARY = {"en": "the quick house and water is good for them with light".split(), "de": "der schnelle haus und wässer ist gut für".split(),
              "fr": "la maison et l'eau est bonne pour être avec lumière".split()}


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == fold(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if fold(r.doc_id) and r.quality is not None]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_learns_nothing_from_the_held_out_fold(tables, spark):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    score = lambda which: {r.doc_id: round(r.score, 9) for r in Q.classify(docs, which).collect()}
    assert score(labels) == score(flipped)


def test_quality_odd_rows(docs_of, spark, long_text):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, long_text), (4, "\x00 \xa0")] + [(i, "### $$$ " * i) for i in range(5, 40)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.classify(docs_of(rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(5, 30)] + [(6, None), (None, 0), (7, 9)], "doc_id long, quality int")
    assert {r.score for r in Q.classify(docs_of(rows), one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    out = Q.classify(docs_of(rows), both).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert Q.classify(docs_of([]), both).count() == 0


def test_language_on_the_held_out_fold(tables):
    docs, _ = tables
    model = L.fit(docs, per_language=150)
    out = {r.doc_id: r for r in L.identify(docs, model).collect()}
    held = [(out[r.doc_id].lang_pred, r.lang) for r in docs.collect() if fold(r.doc_id)]
    assert sum(p == q for p, q in held) / len(held) > 0.97
    assert (model.weights == 0).mean() > 0.3 and model.temperature > 0      # sparse


def test_language_odd_rows(docs_of, long_text):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(VOCABULARY[k], k=30)), k, "s") for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !? 😀 ½ ²", "fr", "s"), (903, "der und haus", None, "s"),
             (None, "la maison", "", "s"), (904, long_text, None, "s"), (5, rows[5][1], rows[5][2], "s")]
    docs = docs_of(rows)
    out = L.identify(docs, L.fit(docs), keep=("lang", "score")).collect()
    assert len(out) == len(rows) and all(0 <= r[2] <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out}
    assert [by[i] for i in (900, 901, 902)] == ["und"] * 3 and by[903] == "de"
    assert sum(by[i] == k for i, _, k, _ in rows[:180]) >= 178
    assert L.identify(docs_of([]), L.fit(docs_of([]))).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs_of([]))).collect()} == {"und"}


def test_language_sample_is_bounded_whatever_repeats(docs_of, spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(VOCABULARY[k], k=12)), k, "s") for i, k in enumerate(["en", "de", "fr"] * 700)]
    same = docs_of([(90, "the same text again", "en", "s")]).crossJoin(spark.range(30_000).select()).repartition(8)
    docs = docs_of(rows).unionByName(same).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sizes = {"en": 701, "de": 700, "fr": 700}
    taken = L.draw(docs, 100, sorted(sizes), sizes)
    counts = {r["lang"]: r["count"] for r in taken.groupBy("lang").count().collect()}
    assert set(counts) == set(sizes) and all(80 <= n <= 100 for n in counts.values())
    assert taken.filter("doc_id = 90").count() <= 1
    assert taken.select("doc_id", "text").distinct().count() == sum(counts.values())
    many = docs_of([(i, "word number " + str(i), f"l{i % 40}", "s") for i in range(400)])
    assert len(L.fit(many, per_language=5, most_languages=7).languages) == 7


# The plain versions: one step at a time, in lists and dictionaries.

def plain_ftrl(examples, c, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
    """Weights by (index, class) after FTRL-proximal over (label, {index: value})."""
    z, n = {}, {}

    def weight(key):
        v = z.get(key, 0.0)
        if abs(v) <= l1:
            return 0.0
        return -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            y, x = examples[k]
            w = {(i, j): weight((i, j)) for i in x for j in range(c)}
            logits = [sum(x[i] * w[i, j] for i in x) for j in range(c)]
            top = max(logits)
            total = sum(math.exp(v - top) for v in logits)
            for j in range(c):
                error = math.exp(logits[j] - top) / total - (j == y)
                for i in x:
                    g, old = error * x[i], n.get((i, j), 0.0)
                    z[i, j] = z.get((i, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, j]
                    n[i, j] = old + g * g
    return {key: weight(key) for key in z}


def test_language_model_equals_plain_ftrl_and_temperature():
    rng, examples = random.Random(6), []
    for _ in range(200):
        y = rng.randrange(3)
        x = {rng.randrange(40) + 13 * y: rng.random() for _ in range(8)} | {L.DIM: 1.0}
        examples.append((y, x))
    packed = [(y, np.array(sorted(x)), np.array([x[i] for i in sorted(x)])) for y, x in examples]
    model = L.train(packed, ["a", "b", "c"], np.ones(L.DIM))
    learn = [e for k, e in enumerate(examples) if k % 5]
    want = plain_ftrl(learn, 3)
    for (i, j), w in want.items():
        got = model.bias[j] if i == L.DIM else model.weights[i, j]
        assert got == pytest.approx(w, rel=1e-4, abs=1e-5)
    assert np.count_nonzero(model.weights) <= sum(w != 0 for w in want.values())

    def loss(t):
        total = 0.0
        for y, x in examples[::5]:
            v = [sum(x[i] * want.get((i, j), 0.0) for i in x) / t for j in range(3)]
            total -= math.log(math.exp(v[y] - max(v)) / sum(math.exp(u - max(v)) for u in v) + 1e-12)
        return total
    grid = [math.exp(math.log(0.02) + k * (math.log(20) - math.log(0.02)) / 60) for k in range(61)]
    assert model.temperature == pytest.approx(min(grid, key=loss), rel=1e-6)


def test_quality_equals_plain_discriminant(spark, tables):
    """Moments, shrinkage and densities row by row against the operator."""
    docs, labels = tables
    docs = docs.limit(400).cache()
    stats = {r.doc_id: np.array(r.x) for r in Q.document_statistics(docs).collect()}
    rows = [(stats[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in stats and r.quality in (0, 1) and not fold(r.doc_id)]
    k = Q.K
    everything = np.array([x for x, _ in rows])
    centre, scale = everything.mean(axis=0), np.sqrt(np.maximum(everything.var(axis=0), 1e-8))
    own, spreads = [], []
    for c in (0, 1):
        z = [(x - centre) / scale for x, y in rows if y == c]
        mean = sum(z) / len(z)
        own.append((len(z), mean))
        spreads.append(sum(np.outer(v - mean, v - mean) for v in z) / len(z))
    pooled = sum(n * s for (n, _), s in zip(own, spreads, strict=True)) / len(rows)
    models = []
    for (n, mean), s in zip(own, spreads, strict=True):
        trace, square = sum(s[i, i] for i in range(k)), sum(s[i, j] ** 2 for i in range(k) for j in range(k))
        rho = min(1.0, max(0.02, ((1 - 2 / k) * square + trace ** 2) / ((n + 1 - 2 / k) * max(square - trace ** 2 / k, 1e-12))))
        target = 0.3 * pooled + 0.7 * np.eye(k) * trace / k
        models.append((mean, (1 - rho) * s + rho * target + 1e-4 * np.eye(k)))
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    for doc_id, x in stats.items():
        z = np.clip((x - centre) / scale, -Q.CLIP, Q.CLIP)
        density = [-0.5 * (z - m) @ np.linalg.inv(s) @ (z - m) - 0.5 * np.linalg.slogdet(s)[1] for m, s in models]
        odds = density[1] - density[0] + math.log(own[1][0] / own[0][0])
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))), rel=1e-5, abs=1e-7)
