"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from factloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id, embedding, label), ids distinct, to the rows of mine."""
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in x], (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in rows if i is not None and x and y is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = set()
    for a, x, label in (r for r in ok if r[0] % 50 == 0):
        scores = sorted((-sum(c * d for c, d in zip(x, z)), i, y == label) for i, z, y in ok if i != a)
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            fit = [(n, i) for n, i, same in scores if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(a, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(fit, 1)}
    return out


def mined(spark, rows):
    got = [tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(seed, n, d, labels=4, scale=1.0):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(9, d))
    x = centres[random_.integers(0, 9, n)] + random_.normal(size=(n, d)) * 0.6
    x[random_.random(n) < 0.2] = x[0]  # a common vector
    x[random_.random(n) < 0.1, 0] *= 40  # outliers
    return [(i, [float(c) for c in v], int(y)) for i, (v, y) in enumerate(zip(x * scale, random_.integers(0, labels, n)))]


@pytest.mark.parametrize("seed, n, d, scale", [(1, 900, 12, 0.2), (2, 400, 3, 0.004), (3, 300, 5, 9_000.0)])
def test_mining_equals_all_scores(spark, seed, n, d, scale):
    rows = vectors(seed, n, d, scale=scale)
    expected = plain(rows)
    assert len(expected) > 20 and mined(spark, rows) == expected


def test_blocks_and_batches(spark, monkeypatch):
    """Several blocks of anchors and many small batches give the same."""
    rows, search = vectors(4, 600, 6), hn.search
    monkeypatch.setattr(hn, "search", lambda *a, **b: search(*a, **b, components=12))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert mined(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bounds_hold_and_leave_most_rows_out():
    random_ = np.random.default_rng(6)
    x = (random_.normal(size=(5000, 32)) * 40).astype(np.int64)
    anchors = x[:20]
    cells = hn.fit_cells(x[:1000], x.min(0), x.max(0))
    codes, exact = cells.codes(x), anchors @ x.T
    tables = cells.tables(anchors)
    total = sum(t[c] for t, c in zip(tables, codes.T)).astype(np.int64)
    low, high = total[:, :20].T, total[:, 20:].T
    assert (low <= exact).all() and (exact <= high).all()
    least, most = np.full(20, 9_000), np.full(20, 17_000)
    can = hn.candidates(low, high, np.ones_like(low, bool), least, most, 3)
    for a in range(20):
        inside = np.flatnonzero((exact[a] >= 9_000) & (exact[a] <= 17_000))
        assert can[a, inside[np.argsort(-exact[a, inside], kind="stable")[:3]]].all()
    assert can.mean() < 0.1


def test_awkward_rows(spark):
    """Nulls everywhere, ties, repeated rows, other lengths, too large values,
    extra columns, no rows, a single row."""
    base = vectors(7, 200, 4)
    odd = [(None, [1.0] * 4, 1), (1000, None, 1), (1050, [1.0] * 4, None), (1100, [1.0, None, 1.0, 1.0], 1), (1150, [1.0, float("nan"), 0.0, 0.0], 1), (1200, [1.0, float("inf"), 0.0, 0.0], 1), (1250, [], 1)]
    expected = plain(base + odd)
    beyond = [(1300, [3e38] * 4, 1), (1350, [1.0] * 5, 1)]
    df = spark.createDataFrame([*base, *base, *odd, *beyond], SCHEMA).selectExpr("*", "1 AS score", "'x' AS rank", "2 AS ids", "3 AS vector", "4 AS x")
    got = hn.mine(df)
    assert {tuple(r) for r in got.collect()} == expected and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark, []) == set() and mined(spark, base[:1]) == set() and mined(spark, odd) == set()
    zero = [(i, [0.0, 0.0], i % 3) for i in range(101)]
    assert mined(spark, zero) == plain(zero)


def test_an_id_with_several_vectors(spark):
    """The smallest is the anchor, and none of its own id is returned."""
    rows = [(50, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (51, [1.0, 0.0], 1), (52, [0.7, 0.7], 2)]
    got = mined(spark, rows)
    assert {(a, p, n) for a, p, _, n, _, _ in got} == {(50, 51, 52)}
    assert {s for *_, s, _ in got} == {math.floor(256 * float(np.float32(0.9))) * 256}
