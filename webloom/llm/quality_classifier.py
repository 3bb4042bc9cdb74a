"""Quality classifier: regularised quadratic discriminant.

Every whole text becomes a vector of document statistics, transformed to be
near normal (logarithms of counts, log-odds of shares).  Class means and
covariances come from sums over all labelled rows that may be learned from;
each covariance is shrunk towards a mix of the pooled covariance and a scaled
identity, its Cholesky factor is kept, and a text's score is the logistic of the
difference of the two Gaussian log-densities (Mahalanobis distances by the
factors) plus the log prior odds.

Nothing is sampled: training sums are small rows added up by Spark.  Texts are
read once, their statistics written to the shared folder and read for the fit
and for the scores.

Defined results: null text counts as empty and is scored like any other;
labels that are null or not 0 or 1 teach nothing, several labels of one id
count each; if one class is missing every score is the share of label 1 (0.5
without labels).  An empty table gives an empty result.  Only the id and the
text are read from the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import held_out, lean, written

#: Function words counted by the stop-word share (fixed values).
STOP = frozenset(("the of and to in that is it for with on by this be at from as was are an a or der die das und den "
                  "von zu mit sich des dem ein eine im für auf nicht le la les de du un une et est en que pour dans "
                  "par sur au el los las del y se por con una su para es lo").encode().split())
FEATURES = ("log_words", "log_word_length", "log_word_length_spread", "unique_words", "stop_words", "symbols",
            "digits", "capitals", "punctuation", "other_bytes", "log_line_words", "unique_lines", "short_lines",
            "stopped_lines", "repeat_share")
K = len(FEATURES)
CLIP = 6.0

_KINDS = np.zeros((256, 5))          # symbols, digits, capitals, punctuation, bytes above ASCII
for _k, _bytes in enumerate((b"#*$%&|<>{}[]\\^~=_@", b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-",
                             bytes(range(128, 256)))):
    _KINDS[list(_bytes), _k] = 1.0


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, half a count added on both sides."""
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    low = text.lower().split()
    distinct = len(set(low))
    size = float(lengths.sum())
    full = sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines)
    return [float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
            _odds(distinct, n) / (1.0 + np.log1p(n) / 4.0), _odds(sum(map(STOP.__contains__, low)), n),
            *(_odds(float(k), size) for k in kinds), float(np.log1p(n / max(len(lines), 1))),
            _odds(len(set(lines)), len(lines)), _odds(sum(len(x) < 20 for x in lines), len(lines)),
            _odds(full, len(lines)), float(np.log1p(len(set(zip(low, low[1:], strict=False)))) - np.log1p(max(n - 1, 0)))]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array ``x`` of statistics of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([statistics(t.as_py()) for t in part.column(1)], dtype=np.float64)
                offsets = np.arange(0, part.num_rows + 1, dtype=np.int32) * K
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                    names=["doc_id", "x"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Standardisation, class means, Cholesky factors and the prior odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray        # (2, K)
    factors: np.ndarray      # (2, K, K), lower
    prior: float             # log odds of label 1
    constant: float | None   # score of everything when a class is missing

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = np.clip(density[1] - density[0] + self.prior, -500.0, 500.0)
        return 1.0 / (1.0 + np.exp(-odds))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and label: count, sums and products of the statistics."""
    total = {}
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy().reshape(-1, K)
        for label in (0, 1):
            own = x[labels == label]
            if len(own):
                total[label] = total.get(label, 0) + np.concatenate(
                    ([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    rows = [(k, i, float(v)) for k, t in total.items() for i, v in enumerate(t)]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in
                                      enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["label", "i", "v"])


def fit(labelled: DataFrame, pooled_share: float = 0.3) -> Discriminant:
    """``labelled``: columns label (0 or 1) and x.  ``pooled_share``: weight of
    the pooled covariance in each class's shrinkage target."""
    sums = labelled.select(F.col("label").cast("int"), "x").mapInArrow(lean(_sums), "label int, i int, v double")
    at = {(r.label, r.i): r.v for r in sums.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()}
    counts = np.array([at.get((c, 0), 0.0) for c in (0, 1)])
    n = counts.sum()
    if counts.min() < 2:
        return Discriminant(np.zeros(K), np.ones(K), np.zeros((2, K)), np.zeros((2, K, K)), 0.0,
                            float(counts[1] / n) if n else 0.5)
    first = np.array([[at[c, 1 + i] for i in range(K)] for c in (0, 1)])
    second = np.array([[at[c, 1 + K + i] for i in range(K * K)] for c in (0, 1)]).reshape(2, K, K)
    centre = first.sum(axis=0) / n
    scale = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / n - centre ** 2, 1e-8))
    means, covariances = np.empty((2, K)), np.empty((2, K, K))
    for c in (0, 1):
        mean = first[c] / counts[c]
        means[c] = (mean - centre) / scale
        covariances[c] = (second[c] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = (covariances * counts[:, None, None]).sum(axis=0) / n
    factors = np.empty((2, K, K))
    for c in (0, 1):
        s = covariances[c]
        target = pooled_share * pooled + (1.0 - pooled_share) * np.eye(K) * np.trace(s) / K
        # Oracle-approximating shrinkage, by the class's own size.
        square, trace = (s * s).sum(), np.trace(s)
        lowest = (counts[c] + 1 - 2 / K) * max(square - trace ** 2 / K, 1e-12)
        rho = min(1.0, max(0.02, ((1 - 2 / K) * square + trace ** 2) / lowest))
        factors[c] = np.linalg.cholesky((1 - rho) * s + rho * target + 1e-4 * np.eye(K))
    return Discriminant(centre, scale, means, factors, float(np.log(counts[1] / counts[0])), None)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row of ``document_statistics``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, K)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())],
                                             names=["doc_id", "score"])
    return stats.select("doc_id", "x").mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from
    labels of documents outside the held-out fold."""
    stats = written(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("label_id"),
                          F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("label_id")))
    model = fit(stats.join(known, F.col("doc_id") == F.col("label_id")).select("label", "x"))
    out = score(stats, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
