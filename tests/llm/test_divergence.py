"""Divergence against plain loops over every kept term."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence as dv

from .brute import AWKWARD, SCHEMA, awkward

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, k=200):
    """rows of (text, lang, source) to the rows of divergence."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= 3) for s in {d[1] for d in own}}
        everything = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(everything)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out |= {(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(ranked, 1)}
    return out


def run(spark, rows, k=200):
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in dv.divergence(df, k=k).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "é", "zz", "日本") for b in "abcdefghij"]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "de", None, "x"]), rnd.choice(["s0", "s0", "s0", "s1", "é", None])
        some = words[: rnd.choice([4, 15, 40])]
        rows.append((rnd.choice([" ", "-", "\t1 "]).join(rnd.choices(some, k=rnd.choice([1, 5, 60]))), lang, source))
    return [*rows, (None, "en", "empty"), ("123 !", "en", "empty"), ("", "alone", "a"), ("", "alone", "b"), ("once", "single", "a")]


@pytest.mark.parametrize("seed, k", [(1, 200), (2, 3)])
def test_divergence_equals_plain_loops(spark, seed, k):
    rows = corpus(seed)
    assert run(spark, rows, k) == plain(rows, k)


def test_top_rows_splits_values_and_ties(spark, tmp_path):
    """Every histogram step: few bits a step, nothing left to the window."""
    rnd = random.Random(5)
    rows = [(g, f"{rnd.choice(['', 'é', 'aa', 'aab'])}{i}", v) for g in "ab" for i, v in enumerate([*rnd.choices(range(1 << 40), k=50), *[7] * 300, 0, 0])]
    spark.createDataFrame(rows, "g string, item string, value long").write.parquet(str(tmp_path / "rows"))
    written = spark.read.parquet(str(tmp_path / "rows"))
    for k in (1, 50, 51, 120, 350, 352, 400):
        expected = {(g, item, v, i) for g in "ab" for i, (g_, item, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode())), 1) if i <= k}
        assert {tuple(r) for r in dv.top_rows(written, ["g"], k, bits=7, spare=0).collect()} == expected


def test_counts_pass_on_in_parts(spark):
    """Flushed counts and cut texts add up to the same."""
    assert [p for p in dv.pieces(b"ab  cd efghij k", 4)] == [b"ab ", b"cd", b"efghij", b"k"]
    assert b" ".join(dv.pieces(b"a bc " * 99, 7)).split() == (b"a bc " * 99).split()
    rows = corpus(3)
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], SCHEMA)
    sums = lambda limit: {tuple(r) for r in dv.count_terms(df, limit).groupBy("lang", "source", "term").agg(F.sum("count"), F.sum("docs")).collect()}
    assert sums(3) == sums(200_000)


def test_awkward_documents(spark):
    got = {tuple(r) for r in dv.divergence(awkward(spark).union(awkward(spark)).union(awkward(spark))).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain([r[1:4] for r in AWKWARD * 3])
    assert dv.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
