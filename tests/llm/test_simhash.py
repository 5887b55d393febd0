"""Fingerprints against counts of bits, components against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash as sh

from .brute import AWKWARD, SCHEMA, awkward, words


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(i)
    return [min((ids[j] for j in groups[root(i)] if ids[j] is not None), default=None) for i in range(len(ids))]


def near(rnd, base, bits):
    for b in rnd.sample(range(64), bits):
        base ^= 1 << b
    return base


def clustered(seed, n=400):
    """Random fingerprints, chains and balls around some of them."""
    rnd = random.Random(seed)
    found = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        found.append(near(rnd, rnd.choice(found), rnd.choice([0, 1, 2, 3, 3, 4, 5])))
    centre = rnd.getrandbits(64)
    found += [near(rnd, centre, rnd.choice([1, 2, 3])) for _ in range(n)]
    return found


def test_fingerprints_equal_counted_bits(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["a", "Bé", "c\x0bd", "日本", "EE\x1fx"], k=k)) for k in (0, 1, 2, 3, 4, 50, 700)] + [" \t", "Ä\x85b c"]
    assert [sh.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = " ".join(rnd.choices("abcdefgh", k=700))
    assert sh.fingerprint(long.encode(), block=100) == plain_fingerprint(long)
    one = "just three words"
    assert spark.range(1).select(F.xxhash64(F.lit(one)).alias("h")).first().h == int(np.uint64(sh.fingerprint(one.encode())).view(np.int64))


@pytest.mark.parametrize("distance, count", [(3, 10), (3, 10**9), (2, 10**12), (3, 10**12)])
def test_a_family_holds_every_close_pair(distance, count):
    sets = sh.families(count, distance)
    rnd = random.Random(distance)
    for _ in range(300):
        changed = set(rnd.sample(range(64), distance))
        assert any(not changed & set(s.tolist()) for s in sets)
    assert all(len(s) <= 56 for s in sets)


@pytest.mark.parametrize("seed, part", [(1, 1024), (2, 16)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, part):
    """Large groups in parts, frequent labels looked up apart."""
    monkeypatch.setattr(sh, "PART", part)
    monkeypatch.setattr(sh, "SHARE", 20)
    prints = clustered(seed)
    signed = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    monkeypatch.setattr(sh, "fingerprints", lambda docs, k: signed)
    got = {r.doc_id: r for r in sh.simhash_groups(signed).collect()}
    assert len(got) == len(prints) and [got[i].component_id for i in range(len(prints))] == plain_components(range(len(prints)), prints)
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in enumerate(prints))


def test_pivots_discard_and_lose_nothing():
    """Distances to pivots differ by the distance at most, and most pairs of
    others by more."""
    prints = np.array(clustered(3), np.uint64)
    far = sh.Pivots().distances(prints)[:, 65:].astype(np.int8)
    one_cell = np.zeros(len(prints), int)
    found = {(i, j) for a, b in sh.near_pairs(one_cell, prints, far, 3) for i, j in zip(a.tolist(), b.tolist())}
    close = np.bitwise_count(prints[:, None] ^ prints) <= 3
    assert found == {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}
    coordinates = (np.abs(far[:, None, :] - far[None]) <= 3).all(2)
    assert (coordinates | ~close).all() and (coordinates & ~close).mean() < 0.05


def test_few_links_for_dense_groups(spark):
    """A cell gives a link per member, not all pairs."""
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    prints = sorted({near(rnd, centre, 1) for _ in range(500)})
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    assert sh.pivot_links(nodes).count() <= 4 * len(prints)


def test_awkward_documents(spark):
    got = sorted((tuple(r) for r in sh.simhash_groups(awkward(spark)).collect()), key=str)
    ids, prints = [r[0] for r in AWKWARD], [plain_fingerprint(r[1]) for r in AWKWARD]
    assert got == sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(ids, prints))), key=str)
    assert sh.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(None, "one two three", "", "", 0), (7, "", "", "", 0)], SCHEMA)
    assert {r.doc_id: r.component_id for r in sh.simhash_groups(alone).collect()} == {None: None, 7: 7}
