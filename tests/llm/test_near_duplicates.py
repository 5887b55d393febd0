"""Components against all pairs."""

import random

import numpy as np
import pytest

from factloom.llm import common
from factloom.llm import near_duplicates as nd
from factloom.operators.components import connected_components

from .brute import AWKWARD, SCHEMA, awkward, components, shingles


def mutated(rnd, base, n):
    w = list(base)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"m{rnd.random()}"
    return " ".join(w)


def documents(seed):
    """Groups of near copies around the threshold, exact copies in other
    case, and texts that share one passage."""
    rnd, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=40)
    for g in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([8, 60, 120]))
        rows += [mutated(rnd, base, rnd.choice([0, 0, 1, 2, 3, 4])) for _ in range(rnd.choice([2, 5, 30]))]
    rows += [" ".join(passage + rnd.choices(vocabulary, k=60)) for _ in range(40)]
    rows += [rows[0].upper(), rows[1] + "\n", "one two", "ONE two", "solo", "", None]
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, k, num, den, sweeps", [(1, 3, 85, 100, 3), (2, 5, 4, 5, 0), (3, 2, 1, 2, 1)])
def test_components_equal_all_pairs(spark, seed, k, num, den, sweeps, monkeypatch):
    plain = nd.components_of
    monkeypatch.setattr(nd, "components_of", lambda d, s, b: plain(d, s, b, sweeps))
    rows = documents(seed)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in nd.near_duplicates(df, nd.Banding((num, den), k)).collect()}
    expected = components(rows, k, num, den)
    assert {i: got[rows[i][0]].component_id for i in expected} == expected
    assert all(got[i].n_shingles == len(shingles(t, k)) and got[i].kept == (got[i].component_id == i) for i, t in rows)


def test_frequent_keys_and_large_buckets(spark, monkeypatch):
    """Buckets in parts of a few nodes, and most keys looked up apart."""
    monkeypatch.setattr(nd, "FAN", 4)
    monkeypatch.setattr(nd, "SHARE", 20)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = [(i, mutated(rnd, base, rnd.choice([0, 0, 1, 1, 2]))) for i in range(150)] + [(1000 + i, mutated(rnd, base[::-1], 1)) for i in range(30)] + [(2000 + i, "") for i in range(40)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in nd.near_duplicates(df, nd.Banding((85, 100), 3)).collect()}
    expected = components(rows, 3, 85, 100)
    assert {i: got[rows[i][0]].component_id for i in expected} == expected and len(got) == len(rows)


def test_lookup_equals_a_join(spark):
    rows = spark.createDataFrame([(i % 7 if i < 200 else i, f"r{i}") for i in range(400)], "k long, r string")
    table = spark.createDataFrame([(i, f"t{i}", None) for i in range(0, 300, 2)], "k long, t string, u string")
    expected = sorted(map(str, rows.join(table, "k", "left").select("k", "r", "t", "u").collect()))
    for hot in ([0, 2, 5], [], range(300)):
        found = common.lookup(rows, table, "k", spark.createDataFrame([(k,) for k in hot], "k long"))
        assert sorted(map(str, found.collect())) == expected
    assert sorted(map(str, common.lookup(rows, table, "k", None).select("k", "r", "t", "u").collect())) == expected
    assert common.frequent(rows, "k") is None and common.frequent(rows.where("k > 9"), "k", 20).collect() == []
    assert sorted(r.k for r in common.frequent(rows.union(rows.where("k < 3")).union(rows.where("k < 3")), "k", 20).collect()) == [0, 1, 2]


def test_awkward_documents(spark):
    rows = nd.near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by_id[i].kept for i in (1, 2, 3, None))
    assert by_id[4].component_id == 4
    kept = nd.unique_documents(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert nd.near_duplicates(awkward(spark).where("false")).collect() == []


def test_null_ids_keep_one_of_a_group(spark):
    df = spark.createDataFrame([(None, f"a b c d e f g h i j k l m n o p q r s t{x}", None, None, None) for x in ("", "", "!")], SCHEMA)
    assert nd.unique_documents(df, nd.Banding((1, 2), 3)).count() == 1


def test_signature_estimates_similarity():
    signer, rng = nd.Signer(nd.Banding(k=3, per_band=6)), np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    hits = np.mean([(signer.signature(a) == signer.signature(b)).mean(), ((signer.signature(a[::-1].copy())) == signer.signature(b)).mean()])
    assert abs(hits - 1500 / 2500) < 0.1


def test_banding_misses_little():
    for b in (nd.Banding(), nd.Banding((85, 100), 3), nd.Banding((1, 2), 3, 3)):
        s = b.similarity[0] / b.similarity[1]
        assert (1 - s**b.per_band) ** b.bands <= b.miss and b.bands % 2 == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in connected_components(links).collect()}
    assert {labels[i] for i in range(201)} == {0} and labels[1001] == 1000
