"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 characters) of the lower-cased
letters of the whole text, as TF-IDF (log term frequency, document frequencies
counted over all documents that may be learned from, unit length).  Weights are
trained by follow-the-regularised-leader (proximal, per-coordinate rates) with
elastic-net penalties on a bounded sample of at most ``per_language`` different
documents of each language, drawn by a hash of id and text; a fifth of the sample
is set aside to calibrate the temperature of the softmax.

Defined results: null text, or a text without a letter, is ``und`` with score
0; without any learnable document everything is ``und``.  Null and empty
languages teach nothing.  Ties go to the language that sorts first.  Repeated rows repeat,
an empty table gives an empty result; only id, text and language are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import held_out, lean, release

BITS = 16
DIM = 1 << BITS
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a text, with repeats; None if it has no letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, letters)):      # numerals such as one half are left in
        return None
    c = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    # The orders start from different offsets, so they hash apart.
    parts = (c * _MIX, (two + np.uint64(1 << 42)) * _MIX, (three ^ np.uint64(1 << 63)) * _MIX)
    return (np.concatenate(parts) >> _SHIFT).astype(np.int64)


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and TF-IDF values, of unit length."""
    found = grams(text)
    if found is None:
        return None
    counts = np.bincount(found, minlength=DIM)
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    return at, values / (np.sqrt((values * values).sum()) or 1.0)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and how many contain each hashed n-gram.  ``texts`` has
    one text column; what reaches the driver is DIM counts at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = grams(text.as_py())
                if found is not None:
                    n += 1
                    has = np.zeros(DIM, bool)
                    has[found] = True
                    total += has
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()),
                                          pa.array(np.append(total[at], n), pa.int64())], names=["i", "n"])

    counts = texts.mapInArrow(lean(run), "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(DIM, np.int64), 0
    for r in counts:
        if r.i < 0:
            n = r.n
        else:
            out[r.i] = r.n
    return n, out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray      # (DIM, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text, self.idf) if self.languages else None
        if x is None:
            return UNKNOWN, 0.0
        p = _softmax((x[1] @ self.weights[x[0]] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, epochs: int = 3,
          alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over (language index, indices, values), where the last
    index is DIM and its value 1 (the bias); every fifth example calibrates
    the temperature instead."""
    c = len(languages)
    z, n = np.zeros((DIM + 1, c)), np.zeros((DIM + 1, c))     # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0.0
        return w

    held, learn = sample[::5], [x for i, x in enumerate(sample) if i % 5] or sample
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(learn)):
            y, at, v = learn[k]
            w = weights(at)
            gradient = _softmax(v @ w)
            gradient[y] -= 1.0
            g = v[:, None] * gradient
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    final = weights(np.arange(DIM + 1))
    model = Model(languages, idf, final[:-1].astype(np.float32), final[-1])
    logits = np.array([v @ final[at] for _, at, v in held]).reshape(-1, c)
    truth = np.array([y for y, _, _ in held], dtype=np.int64)
    if len(held) and c > 1:
        grid = np.exp(np.linspace(np.log(0.02), np.log(20.0), 61))
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def draw(rows: DataFrame, per_language: int, languages: list[str], sizes: dict[str, int]) -> DataFrame:
    """At most ``per_language`` different rows (doc_id, text) of each language:
    those with the smallest hashes.  Rows are thinned by their hash first and
    equal rows become one where they lie, so that no task gathers a language or
    the copies of a row."""
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 4.0 * per_language / sizes[k]))])
    key = F.xxhash64(F.lit("sample"), "doc_id", "text")
    thinned = (rows.withColumn("key", key)
               .filter(F.pmod("key", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(share, F.col("lang")))
               .groupBy("lang", "key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))
    order = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "key")
    return thinned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 1000, most_languages: int = 128) -> Model:
    """Learn from rows outside the held-out fold with a language.

    The sample bound: ``per_language`` different rows of each of the
    ``most_languages`` languages with most rows; only their n-gram counts (DIM
    at most each) come to the driver.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "")
                       & ~held_out(F.col("doc_id")))
    sizes = {r.lang: max(1, r.different) for r in
             rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("different"))
             .orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(DIM), np.zeros((DIM, 0), np.float32), np.zeros(0))
    n, frequency = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 1.0
    sample = draw(rows, per_language, languages, sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = grams(batch.column(1)[k].as_py())
                if found is None:
                    continue
                counts = np.bincount(found, minlength=DIM)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(2).slice(k, 1),
                     pa.array([at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()], pa.binary())],
                    names=["doc_id", "lang", "packed"])

    taken = sample.select("doc_id", "text", "lang").mapInArrow(lean(count), "doc_id long, lang string, packed binary").collect()
    examples = []
    for r in sorted(taken, key=lambda r: (hash((r.doc_id, 11)), r.doc_id, r.lang, bytes(r.packed))):
        size = len(r.packed) // 6
        at = np.frombuffer(r.packed, np.uint16, size).astype(np.int64)
        values = (1.0 + np.log(np.frombuffer(r.packed, np.uint32, size, 2 * size))) * idf[at]
        values /= np.sqrt((values * values).sum())
        examples.append((languages.index(r.lang), np.append(at, DIM).astype(np.int32), np.append(values, 1.0).astype(np.float32)))
    del taken
    model = train(examples, languages, idf)
    del examples
    release()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the columns in ``keep``."""
    packed = docs.sparkSession.sparkContext.broadcast(model)   # DIM times languages weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packed.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [own.predict(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64()), *part.columns[2:]],
                    names=["doc_id", "lang_pred", "score", *[f"keep_{k}" for k in range(len(keep))]])

    extra = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"), *extra)
    types = "".join(f", keep_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    return (rows.mapInArrow(lean(run), f"doc_id long, lang_pred string, score double{types}")
            .withColumnsRenamed({f"keep_{k}": c for k, c in enumerate(keep)}))
