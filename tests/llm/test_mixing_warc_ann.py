"""Mixing, archives, neighbours."""

import gzip
import hashlib
import io
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import mixing, neighbours, warc

from .brute import AWKWARD, SCHEMA, awkward, words


def filled(sizes, weights, share, most):
    """Clamp and reshare until no target is above its cap."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        targets = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if targets[s] > most * sizes[s]]
        if not over:
            return targets | fixed
        fixed |= {s: most * sizes[s] for s in over}


def mixed_case(seed, n=600):
    rng = np.random.default_rng(seed)
    sources = [*"abcdefg", None]
    return [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", sources[min(int(rng.exponential(1.5)), 7)], 1) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_against_plain_water_filling(spark, seed):
    rows = mixed_case(seed)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    taken = {}
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed_documents(df).count() == sum(r.repeats for r in got)
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    expected = con.sql(mixing.ORACLE).fetchall()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(expected)


def test_mix_of_awkward_documents(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD) and {r.taken for r in rows if r.size == 0} == {0}
    assert mixing.mixed_documents(awkward(spark)).columns == awkward(spark).columns
    assert mixing.mix(awkward(spark).where("false")).collect() == []
    assert {r.taken for r in mixing.mix(awkward(spark).where("doc_id < 3")).collect()} == {0}


PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark):
    long, short = "<p>é" + "x" * 200, "<p>short"
    rows = [(5, "http://a/b c\r\nX: y", long, "x"), (3, "u", long, "x"), (9, None, long, "x"), (1, "u", short, "x"), (2, "u", short, "x"), (4, "u", None, "x"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "x"), (None, "u", long, "x")]
    archives = warc.archive_pages(spark.createDataFrame(rows, PAGES))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()}
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert {k: v[:2] for k, v in got.items()} == {k: (len(t), hashlib.sha256(t).hexdigest()) for k, t in text.items()}
    assert {k: v[2:] for k, v in got.items()} == {5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3), **{k: ("response", None) for k in (3, 1, 2, 4, 7)}}
    assert warc.read_archives(warc.archive_pages(spark.createDataFrame([], PAGES))).collect() == []


def test_a_frequent_page_is_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARE", 4)
    rows = [(i, "u", ("<p>" + "y" * 200) if i % 2 else ["", "<i>", "<p>" + "z" * (100 + i // 8)][i % 3], "x") for i in range(60, 0, -1)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.archive_pages(spark.createDataFrame(rows, PAGES))).collect()}
    first = {}
    for i, _, html, _ in sorted(rows):
        first.setdefault(html if len(html) >= 100 else i, i)
    expected = {i: first[html if len(html) >= 100 else i] for i, _, html, _ in rows}
    assert got == {i: ("response", None) if f == i else ("revisit", f) for i, f in expected.items()}


def test_normalised_members_stand_alone():
    records = [warc.record(i, "u", b"x" * n, "d", None) for i, n in enumerate([0, 5, 300_000])]
    sink = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), sink)
    data = sink.getvalue()
    assert gzip.decompress(data) == b"".join(records)
    for row, r in zip(index.to_pylist(), records):
        assert zlib.decompress(data[row["offset"] : row["offset"] + row["length"]], 31) == r
    again = io.BytesIO()
    assert warc.normalise(io.BytesIO(data), again).equals(index) and again.getvalue() == data
    fields, block = warc.read_member(io.BytesIO(data), *[index.to_pylist()[1][k] for k in ("offset", "length")])
    assert fields["warc-type"] == "response" and block.endswith(b"\r\n\r\nxxxxx")


@pytest.mark.parametrize("broken", [lambda d: gzip.compress(d)[:-20], lambda d: gzip.compress(d[:-10]), lambda d: gzip.compress(b"HTTP/1.1\r\n\r\n")])
def test_broken_archives_are_errors(broken):
    data = warc.record(1, "u", b"x" * 5000, "d", None)
    with pytest.raises((EOFError, ValueError, zlib.error)):
        warc.normalise(io.BytesIO(broken(data)), io.BytesIO())


VECTORS = "vec_id long, embedding array<float>, label int, rank int"


def nearest_plain(rows, k, modulus):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in sorted(i for i in good if i % modulus == 0):
        scores = sorted((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, rows[7][1])]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (1250, [1.0] * 5), (None, [1.0] * 8), (1300, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(df, k=5, modulus=50, rerank=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == nearest_plain(rows, 5, 50)


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in neighbours.nearest(df, k=5, modulus=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & got[q])
    assert hits / (80 * 5) >= 0.9


def test_neighbours_in_a_tight_group_equal_brute_force(spark):
    """A third of all rows nearly parallel, more than are scored first, and
    with few codes among them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[::3] = (x[0] + 1e-4 * rng.normal(size=(1000, 64))) * rng.uniform(0.5, 2, (1000, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    got = {}
    for r in neighbours.nearest(df, k=5, modulus=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=1e-14)))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, 3000, 60):
        s = u @ u[q]
        s[q] = -9
        assert [(i, s[i]) for i in np.argsort(-s)[:5]] == got[q]


def test_very_large_and_very_small_components(spark):
    big, small = 2.0**660, 2.0**-660
    pairs = [(big, big), (big, 2 * big), (small, small), (small, 3 * small), (1.0, 2.0), (-1e308, 1.7e308), (5e-324, 0.0)]
    df = spark.createDataFrame([(50 * i, list(v)) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = np.array([np.longdouble(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for v in pairs]).astype(float)
    for i, query in enumerate(u):
        order = sorted((-round(float(query @ v), 12), 50 * j) for j, v in enumerate(u) if j != i)[:5]
        assert [(rank, v, round(s, 12)) for rank, v, s in sorted(got[50 * i])] == [(n + 1, v, -s) for n, (s, v) in enumerate(order)]


def test_scaling_changes_no_cosine():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 500, 40)) * np.exp(rng.normal(size=(2, 500, 1)) * 9)
    plain = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    assert (neighbours.cosine(neighbours.scaled(a), neighbours.scaled(b)) == plain).all()


def test_queries_in_blocks_find_the_same(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    vectors = neighbours.valid_vectors(df)
    index, queries = neighbours.build_index(vectors, 6), vectors.selectExpr("vec_id as qid", "vector").where("qid % 3 = 0")
    rows = lambda block: sorted(map(tuple, neighbours.search(index, queries, 5, block=block).collect()))
    assert rows(7) == rows(8192) and len(rows(7)) == 600


def test_least_approximate_is_a_bound():
    rng = np.random.default_rng(4)
    q, c, v = (neighbours.unit(rng.normal(size=(20_000, 3))) for _ in range(3))
    cos = lambda a, b: np.einsum("ij,ij->i", a, b)
    for floor in (-2.0, -0.9, -0.3, 0.0, 0.5, 0.99):
        reach = cos(q, v) >= floor
        assert (cos(q, c) >= neighbours.least_approximate(floor, cos(c, v)) - 1e-12)[reach].all()
    assert (cos(q, c) < neighbours.least_approximate(0.9, cos(c, v))).any()


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [1.0, 1.0], 0, 0), (1, [1.0, 1.0], 0, 0)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(few.where("false")).collect() == []
