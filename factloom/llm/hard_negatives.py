"""Hard negatives by a vector-approximation file.

Every component is quantised into a cell of its dimension, and the file holds
one byte of cell number per dimension beside the exact vector. For an anchor, a
table per dimension gives the least and the largest product of its component
with any that a cell can hold; adding up a row's entries bounds its score from
below and above. A row is scored exactly only if its bounds let it lie in the
window asked for, and no worse than as many rows that surely lie there.

Both searches are of this kind: the positives of an anchor are the best rows of
its label without a window, the negatives of a positive the best of other
labels in the window that the positive's score sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, materialize
from .neighbours import matrix

FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
#: The range of scores, and what stands for an id that isn't there.
LEAST, MOST, NO_ID = -(1 << 62), 1 << 62, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Cells:
    """Per dimension the cells' first values, and the least and the largest
    value that each holds."""

    cuts: list[np.ndarray]
    lows: np.ndarray  # dimension x cells
    highs: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, d], "right") for d, cut in enumerate(self.cuts)], 1).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """dimension x cell x (lower bounds of all anchors, then upper ones)."""
        a = anchors.T[:, None, :]
        p, q = a * self.lows[:, :, None], a * self.highs[:, :, None]
        both = np.concatenate([np.minimum(p, q), np.maximum(p, q)], 2)
        fits = np.abs(both).max((1, 2), initial=0).sum() < 1 << 31
        return both.astype(np.int32) if fits else both


def fit_cells(sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = 64) -> Cells:
    """Cells of equal width over all but the outermost thousandths of the
    sample; the first and the last reach to the least and the largest value of
    all rows."""
    ends = np.quantile(sample, [0.001, 0.999], axis=0)
    cuts = [np.unique(np.ceil(np.linspace(lo, hi, cells - 1)).astype(np.int64)) for lo, hi in ends.T]
    lows, highs = np.zeros((len(cuts), cells), np.int64), np.zeros((len(cuts), cells), np.int64)
    for d, cut in enumerate(cuts):
        lows[d, : len(cut) + 1] = np.r_[min(least[d], cut[0]), cut]
        highs[d, : len(cut) + 1] = np.r_[cut - 1, max(most[d], cut[-1])]
    return Cells(cuts, lows, highs)


def scaled_rows(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (array of int) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("x") > 0))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    # A product of two vectors is to fit a long.
    largest = min(math.isqrt((MOST - 1) // max(1, size[0].d if size else 1)), (1 << 31) - 1) - 1
    rows = rows.where((F.size("x") == (size[0].d if size else -1)) & F.forall("x", lambda v: F.abs(v * scale) < largest))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("vector"))


@dataclass(frozen=True)
class File:
    cells: Cells
    rows: DataFrame  # label, vector, ids (smallest first, padded), codes


def build_file(rows: DataFrame, per_vector: int, sample: int = 16_384) -> File | None:
    """The approximation file of ``rows`` (vec_id, label, vector; written).
    Rows equal in label and vector are one, with the ``per_vector`` smallest
    ids: a result has no room for more. Cells are fitted on at most ``sample``
    rows, those of the smallest hash, and reach over the values of all."""
    order = Window.partitionBy("label", "vector").orderBy("vec_id")
    ranked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_vector)
    grouped = materialize(ranked.groupBy("label", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("label", "vector", "ids"), "negatives-rows")
    chosen = grouped.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(sample).toArrow()
    if not chosen.num_rows:
        return None
    ends = grouped.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most")).orderBy("d").toArrow()
    cells = fit_cells(matrix(chosen.column("vector").combine_chunks()), *(ends.column(c).to_numpy() for c in ("least", "most")))

    def run(batches):
        for batch in batches:
            codes = cells.codes(matrix(batch.column("vector")))
            yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["label", "vector", "ids", "codes"])

    return File(cells, materialize(grouped.mapInArrow(run, "label long, vector array<int>, ids array<long>, codes binary"), "negatives-file"))


class Block:
    """Anchors, and the windows in which rows are asked for."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("label")
        self.ids, self.labels, self.vectors = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("vector").combine_chunks()).astype(np.int64)
        windows = [(i, *w.values()) for i, some in enumerate(table.column("windows").to_pylist()) for w in some]
        self.of, self.positives, self.scores, self.least, self.most = (np.array(c, np.int64) for c in (zip(*windows) if windows else ([],) * 5))


def first_of(window: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each window: larger scores, then smaller ids."""
    order = np.lexsort((row, -score, window))
    window, score, row = window[order], score[order], row[order]
    rank = np.arange(len(window)) - np.searchsorted(window, window)
    return window[rank < k], score[rank < k], row[rank < k]


def candidates(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Which rows (columns) of each window may be among its ``k`` best, by
    bounds of their scores. One row more is taken as sure, for the anchor's
    own may be one of them."""
    sure = np.where(allowed & (low >= least[:, None]) & (high <= most[:, None]), low, LEAST)
    if sure.shape[1] > k:
        least = np.maximum(least, np.partition(sure, -k - 1, 1)[:, -k - 1])
    return allowed & (low <= most[:, None]) & (high >= least[:, None])


def _scan(file: File, shared, k: int, same: bool, group: int = 64) -> DataFrame:
    """Per task, the ``k`` best rows of each window of the block; ``same``
    says whether they have the anchor's label or another."""

    def run(batches):
        block, cells = shared.value
        # Anchors in groups; those of a group that asks for its own label have one.
        cuts = np.flatnonzero(np.r_[True, block.labels[1:] != block.labels[:-1]]) if same else np.array([0])
        groups = [(at, min(at + group, end)) for start, end in zip(cuts, [*cuts[1:], len(block.ids)]) for at in range(start, end, group)]
        best = {g: tuple(np.empty(0, np.int64) for _ in range(3)) for g in groups}
        floor = np.full(len(block.of), LEAST)
        windows = {(i, j): np.flatnonzero((block.of >= i) & (block.of < j)) for i, j in groups}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, ids = batch.column("label").to_numpy(), batch.column("ids")
            x = matrix(batch.column("vector")).astype(np.int64)
            width = np.diff(ids.offsets.to_numpy())
            known = np.full((len(x), width.max()), NO_ID)
            known[np.arange(known.shape[1]) < width[:, None]] = ids.flatten().to_numpy()
            codes = np.ascontiguousarray(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), -1).T)
            for i, j in groups:
                rows = np.flatnonzero(labels == block.labels[i]) if same else np.arange(len(x))
                w = windows[i, j]
                if not len(rows) or not len(w):
                    continue
                tables = cells.tables(block.vectors[i:j])
                total = np.zeros((len(rows), tables.shape[2]), tables.dtype)
                for t, c in zip(tables, codes):
                    total += np.take(t, c[rows] if same else c, axis=0)
                low, high = total[:, : j - i].T, total[:, j - i :].T
                of = block.of[w] - i
                allowed = np.ones((len(w), len(rows)), bool) if same else (labels[None, rows] != block.labels[i:j, None])[of]
                can = candidates(low[of], high[of], allowed, np.maximum(block.least[w], floor[w]), block.most[w], k)
                window, row = np.nonzero(can)
                row = rows[row]
                exact = np.einsum("ij,ij->i", block.vectors[block.of[w[window]]], x[row])
                fit = (exact >= block.least[w[window]]) & (exact <= block.most[w[window]])
                window, row, exact = w[window[fit]], row[fit], exact[fit]
                found = known[row]
                real = (found != NO_ID) & (found != block.ids[block.of[window]][:, None])
                new = (np.broadcast_to(v[:, None], found.shape)[real] for v in (window, exact))
                best[i, j] = first_of(*(np.concatenate(c) for c in zip(best[i, j], (*new, found[real]))), k)
                full, score, _ = best[i, j]
                counts = np.searchsorted(full, w, "right") - np.searchsorted(full, w)
                floor[w[counts == k]] = score[np.searchsorted(full, w[counts == k], "right") - 1]
        for window, score, row in best.values():
            if len(window):
                yield pa.record_batch([pa.array(c) for c in (block.ids[block.of[window]], block.positives[window], block.scores[window], row, score)], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return file.rows.mapInArrow(run, FOUND)


def search(file: File, anchors: DataFrame, k: int, same: bool, components: int = 1 << 19) -> DataFrame:
    """FOUND with ``rank``: the ``k`` best rows of each window of ``anchors``
    (vec_id, label, vector, windows: array of positive_id, positive_score,
    least, most).

    Anchors go to the tasks in blocks of about ``components`` vector
    components, one block at a time; each task keeps the best of its part,
    which are written before the next block is sent.
    """
    spark = anchors.sparkSession
    blocks = -(-anchors.count() * len(file.cells.cuts) // components)

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            held = Block(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "label", "vector", "windows").toArrow())
            shared = spark.sparkContext.broadcast((held, file.cells))
            yield _scan(file, shared, k, same)
            shared.destroy()

    found = appended(spark, parts(), FOUND, "negatives-found")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 3, modulus: int = 50) -> DataFrame:
    """Of ``embeddings`` (vec_id, embedding, label): anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``modulus``; their
    positives are the best rows of their label, and a positive's negatives the
    best rows of other labels that score from half to 95 % of it. A positive
    without such a row gives none, as does one that scores below zero.

    Rows without id, label or vector, with a null or non-finite component, or
    whose vector is not of the commonest length take no part, nor do those
    with components so large (1.0e6 at 64 dimensions) that products of two
    would not fit a long. Rows equal in id, label and vector count once; where
    an id repeats otherwise, each row is a candidate, and the smallest is the
    anchor, never with a row of its own id. Ties go to the smaller id. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = materialize(scaled_rows(embeddings).distinct(), "negatives-valid")
    file = build_file(rows, max(positives, negatives) + 1)
    if file is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    first = rows.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("r"))
    window = lambda other, score, least, most: F.struct(other.cast("long").alias("positive_id"), score.cast("long").alias("positive_score"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    everything = F.array(window(F.lit(-1), F.lit(0), F.lit(LEAST), F.lit(MOST)))
    anchors = materialize(first.select("vec_id", "r.label", "r.vector", everything.alias("windows")), "negatives-anchors")

    near = search(file, anchors, positives, same=True)
    score = F.col("score")
    most = F.expr("score div 20 * 19 + (score % 20) * 19 div 20")  # floor of 95 %, for scores of 0 and more
    ranges = near.where(score >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window(F.col("vec_id"), score, F.expr("score div 2 + score % 2"), most)).alias("windows"))
    asked = materialize(anchors.drop("windows").join(ranges, "vec_id"), "negatives-asked")
    found = search(file, asked, negatives, same=False)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
