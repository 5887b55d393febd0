"""Quality scores by a regularised quadratic discriminant.

Each text gives a fixed vector of transformed statistics (log ratios and log
counts, so that both classes are closer to Gaussian). Each class gets its
mean and its covariance, shrunk towards the diagonal of the pooled one; the
score compares the two log densities, whose Mahalanobis terms come from
Cholesky factors that are computed once per model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Byte classes of the statistics; lead and continuation bytes follow.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'\"()-", b"!?", b"#$%&*@^~", b"|/\\_=+<>[]{}")
STATISTICS = (
    "log_words", "upper", "digits", "spaces", "newlines", "points", "marks", "symbols", "bars",
    "letters", "distinct_words", "distinct_lines", "word_length", "short_words", "adjacent_repeats",
)


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES) + 2))
    for i, members in enumerate(CLASSES):
        m[list(members), i] = 1
    m[0xC0:, -2] = 1
    m[0x80:0xC0, -1] = 1
    return m


CLASS_MATRIX = _class_matrix()


def statistics(text: bytes) -> list[float]:
    """The vector of one whole text, in the order of STATISTICS; defined for
    an empty text, too."""
    upper, lower, digits, spaces, newlines, points, marks, symbols, bars, leads, rest = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASS_MATRIX
    chars, letters = len(text) - rest, upper + lower + leads
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    ratio = lambda part, whole: float(np.log((part + 0.5) / (whole + 1)))
    return [
        float(np.log1p(n)), ratio(upper, letters), ratio(digits, chars), ratio(spaces, chars), ratio(newlines, n), ratio(points, n), ratio(marks, n), ratio(symbols, n), ratio(bars, n),
        ratio(letters, chars), ratio(len({w.lower() for w in words}), n), ratio(len(set(lines)), len(lines)), chars / (n + 1), ratio(sum(map((4).__gt__, map(len, words))), n), ratio(sum(map(bytes.__eq__, words, words[1:])), n),
    ]


def vectors(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))


@dataclass(frozen=True)
class Discriminant:
    """means, whiteners (inverted Cholesky factors) and constants of class 0
    and 1. Without a class in the training rows: scores of 0.5."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not np.isfinite(self.constants).all():
            return np.full(len(x), 0.5)
        densities = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiteners, self.constants)]
        # Divided by the dimension, so that far texts still differ in score.
        return 1 / (1 + np.exp(np.clip((densities[0] - densities[1]) / x.shape[1], -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float) -> Discriminant:
    """From each class's rows, sum of vectors and sum of outer products."""
    p = sums.shape[1]
    safe = np.maximum(counts, 1)[:, None]
    means = sums / safe
    covariances = squares / safe[:, :, None] - means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.tensordot(counts, covariances, 1) / max(counts.sum(), 1)).copy() + 1e-6
    whiteners, constants = [], []
    for n, c in zip(counts, covariances):
        factor = np.linalg.cholesky((1 - shrinkage) * c + shrinkage * np.diag(pooled))
        whiteners.append(np.linalg.solve(factor, np.eye(p)))
        constants.append((np.log(n / counts.sum()) if n else -np.inf) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiteners), np.array(constants))


def held_out(modulus: int = 3, remainder: int = 1):
    """Whether a document's labels are kept from the fit."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, quality, weight of at most ``sample`` labels that are not held
    out, those with the smallest hash. The same label given again weighs
    again."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).agg(F.count(F.lit(1)).alias("weight"))
    return marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, sample: int = 20_000) -> Discriminant:
    """Fit on the documents of at most ``sample`` labels (see training_rows),
    so many rows being what is broadcast. Only class sums leave the executors:
    per class one count, p sums and p(p+1)/2 products."""
    p = len(STATISTICS)
    upper = np.triu_indices(p)

    def run(batches):
        total = np.zeros((2, 1 + p + len(upper[0])))
        for batch in slices(batches):
            x = vectors(utf8(batch.column("text")))
            w, q = batch.column("weight").to_numpy(), batch.column("quality").to_numpy()
            for k in (0, 1):
                wk, xk = w[q == k].astype(float), x[q == k]
                total[k] += np.r_[wk.sum(), wk @ xk, ((xk * wk[:, None]).T @ xk)[upper]]
        n = total.shape[1]
        yield pa.record_batch([pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), 2)), pa.array(total.ravel())], names=["quality", "i", "v"])

    marked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(training_rows(labels, sample)), "doc_id")
    rows = marked.select("text", "quality", "weight").mapInArrow(run, "quality int, i int, v double").groupBy("quality", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + p + len(upper[0])))
    for r in rows:
        sums[r.quality, r.i] = r.v
    squares = np.zeros((2, p, p))
    for k in (0, 1):
        squares[k][upper] = sums[k, 1 + p :]
        squares[k] = squares[k] + squares[k].T - np.diag(np.diag(squares[k]))
    return discriminant(sums[:, 0], sums[:, 1 : 1 + p], squares, shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, sample: int = 20_000) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): held_out, score, predicted.

    Labels (doc_id, quality) other than 0 and 1 or without id are ignored;
    repeated labels count as often; repeated documents get a row each. Null
    text scores as empty. A null doc_id stays null and is not held out. With
    no rows of a class to learn from, every score is 0.5. Other columns of
    both tables are ignored, and no id, label or source enters a score. The
    fit takes at most ``sample`` labels; every document is scored.
    """
    model = fit(docs, labels, shrinkage, sample)

    def run(batches):
        for batch in slices(batches):
            s = model.scores(vectors(utf8(batch.column("text"))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns as they are."""
    model, at = fit(docs, labels, shrinkage, sample), docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(model.scores(vectors(utf8(batch.column(at)))) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
