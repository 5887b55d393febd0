"""Matching and metrics against plain sequential versions."""

import hashlib
import math
import random

import pytest

from factloom.operators import evaluation as E
from factloom.plans import catalog
from factloom.plans.scoring import evaluate, metrics, score

GOLD = "event_id string, article_id string, evidence_quote_raw string, event_term_raw string, category_canonical string, numerator_value string, denominator_value string, arm_raw string, arm_canonical string, time_raw string, time_canonical string, poolability string"
PRED = "prediction_id string, article_id string, evidence_quote string, raw_event_term string, predicted_category string, arm string, numerator bigint, denominator bigint, time_window string, poolability string"
ARTICLES = "article_id string, eligible string, harms_status string, publication_version string"


def gold(event, article, quote, term, category="C", n="1", d="10", arm="Control group", canon="control", time="2 wks", time_canon="2 weeks"):
    return (event, article, quote, term, category, n, d, arm, canon, time, time_canon, "Directly poolable")


def pred(p, article, quote, term, category="C", n=1, d=10, arm="control group", time="2 weeks"):
    return (p, article, quote, term, category, arm, n, d, time, "Directly poolable")


def matched(spark, g, p):
    e = E.edges(spark.createDataFrame(g, GOLD), spark.createDataFrame(p, PRED))
    return sorted((r.event_id, r.prediction_id) for r in E.greedy(e).collect())


def test_category_alone_or_numbers_don_t_match(spark):
    assert matched(spark, [gold("G1", "A", "alpha beta gamma", "alpha")], [pred("P1", "A", "delta epsilon", "zeta")]) == []
    assert matched(spark, [gold("G1", "A", "alpha beta gamma", "alpha", n="5")], [pred("P1", "A", "alpha beta gamma", "alpha", n=9)]) == [("G1", "P1")]


def test_matches_stay_within_articles(spark):
    assert matched(spark, [gold("G1", "A", "alpha beta", "alpha")], [pred("P1", "B", "alpha beta", "alpha")]) == []


def test_ties_go_to_ids_whatever_the_order(spark):
    g = [gold(f"G{i}", "A", "alpha beta gamma", "alpha") for i in (2, 1)]
    p = [pred(f"P{i}", "A", "alpha beta gamma", "alpha") for i in (2, 1)]
    assert matched(spark, g, p) == [("G1", "P1"), ("G2", "P2")] == matched(spark, g[::-1], p[::-1])


def sequential(rows):
    used, out = set(), []
    for r in sorted(rows, key=lambda r: (-r.rank_score, -r.quote_jaccard, -r.term_similarity, r.event_id, r.prediction_id)):
        if not used & {("g", r.article_id, r.event_id), ("p", r.article_id, r.prediction_id)}:
            used |= {("g", r.article_id, r.event_id), ("p", r.article_id, r.prediction_id)}
            out.append((r.article_id, r.event_id, r.prediction_id))
    return sorted(out)


def test_matches_equal_the_sequential_choice(spark):
    rnd = random.Random(4)
    words = "alpha beta gamma delta knee pain deep".split()
    text = lambda: " ".join(rnd.choices(words, k=4))
    g = [gold(f"G{i:03d}", f"A{i % 3}", text(), rnd.choice(words), rnd.choice("CD")) for i in range(90)]
    p = [pred(f"P{i:03d}", f"A{i % 3}", text(), rnd.choice(words), rnd.choice("CD")) for i in range(90)]
    e = E.edges(spark.createDataFrame(g, GOLD), spark.createDataFrame(p, PRED))
    rows = e.collect()
    assert len(rows) > 300
    assert sorted((r.article_id, r.event_id, r.prediction_id) for r in E.greedy(e).collect()) == sequential(rows)


def small(spark):
    articles = spark.createDataFrame([("A1", "yes", "Yes", "VOR"), ("A2", "Yes", "no", "VOR"), ("A3", "no", "Yes", "PUBLISHER_AIP_COMPLETE")], ARTICLES)
    g = [gold("G1", "A1", "alpha beta gamma", "alpha"), gold("G2", "A1", "omega psi", "chi"), gold("G3", "A3", "alpha beta", "alpha")]
    p = [pred("P1", "A1", "alpha beta gamma", "alpha"), pred("P2", "A2", "delta", "delta"), pred("P3", "A3", "alpha beta", "alpha")]
    return articles, spark.createDataFrame(g, GOLD), spark.createDataFrame(p, PRED)


def test_evaluation(spark):
    r = evaluate(*small(spark), "label", 50)
    m = metrics(r)
    level = m["event_level"]
    # Events of articles that are not eligible stay in the reference.
    assert (level["TP"], level["FP"], level["FN"]) == (1, 1, 2)
    assert level["precision"] == 0.5 and level["recall"] == pytest.approx(1 / 3) and level["f1"] == pytest.approx(0.4)
    assert level["precision_ci95"] == pytest.approx([0.0945312057, 0.9054687943])
    f = m["field_metrics_conditional_on_event_match"]
    assert [f[k]["correct"] for k in ("arm_raw_exact", "arm_canonical_exact", "time_raw_exact", "time_canonical_exact", "numerator_value_exact")] == [1, 1, 0, 1, 1]
    assert {x.article_id: (x.tp, x.fp, x.fn) for x in r["counts"].collect()} == {"A1": (1, 0, 1), "A2": (0, 1, 0)}


def test_signals_and_confusion(spark):
    articles, _, p = small(spark)
    s = E.article_signals(articles, p)
    assert {r.article_id: r.classification for r in s.collect()} == {"A1": "TP", "A2": "FP"}
    c = E.confusion(s).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.sensitivity, c.specificity, c.accuracy) == (1, 1, 0, 0, 1.0, 0.0, 0.5)
    empty = E.confusion(s.where("false")).first()
    assert empty.sensitivity is None and empty.accuracy_ci95.low is None and empty.f1 is None


def test_no_rows_at_all(spark):
    articles, g, p = (df.where("false") for df in small(spark))
    m = metrics(evaluate(articles, g, p, "label", 10))["event_level"]
    assert (m["TP"], m["precision"], m["f1"], m["recall_ci95"]) == (0, 0.0, 0.0, [None, None])


def test_bootstrap_draws(spark):
    counts = {"A1": (3, 1, 2), "A2": (1, 2, 1), "A3": (0, 1, 3)}
    generator = random.Random(int(hashlib.sha256(b"seed").hexdigest()[:16], 16))
    values = []
    for _ in range(200):
        ids = [sorted(counts)[generator.randrange(3)] for _ in range(3)]
        tp, fp, _ = (sum(counts[i][k] for i in ids) for k in range(3))
        values.append(tp / (tp + fp) if tp + fp else 0.0)
    values.sort()

    def quantile(q):
        at = (len(values) - 1) * q
        a, b = math.floor(at), math.ceil(at)
        return values[a] if a == b else values[a] * (b - at) + values[b] * (at - a)

    df = spark.createDataFrame([(k, *v) for k, v in counts.items()], "article_id string, tp long, fp long, fn long")
    assert E.bootstrap(df, "seed", 200).first().precision == pytest.approx([quantile(0.025), quantile(0.975)])


@pytest.mark.parametrize("n, step", [(1, 1024), (2, 700), (7, 100), (64, 1 << 16), (1000, 999)])
def test_draws_are_those_of_the_seeded_sequence(n, step):
    """From every state on, whatever the steps of the scan and the blocks."""
    generator = random.Random(int(hashlib.sha256(b"label").hexdigest()[:16], 16))
    rows = {}
    for first, count, *state in E.replicate_states(n, "label", 45, each=10, step=step):
        for at, places in E.replicate_places(n, count, *state, block=300):
            rows.setdefault(first + at, []).extend(places.tolist())
    assert [rows[i] for i in range(45)] == [[generator.randrange(n) for _ in range(n)] for _ in range(45)]


def test_bootstrap_sums_in_chunks_of_articles(spark):
    counts = spark.createDataFrame([(f"A{i:03d}", i % 3, i % 5, i % 2) for i in range(100)], "article_id string, tp long, fp long, fn long")
    whole = sorted(map(tuple, E.replicate_sums(counts, "label", 130).collect()))
    assert whole == sorted(map(tuple, E.replicate_sums(counts, "label", 130, chunk=33).collect())) and len(whole) == 130
    generator, values = random.Random(int(hashlib.sha256(b"label").hexdigest()[:16], 16)), [(i % 3, i % 5, i % 2) for i in range(100)]
    draws = [[values[generator.randrange(100)] for _ in range(100)] for _ in range(130)]
    assert whole == [(i, *map(sum, zip(*d))) for i, d in enumerate(draws)]


def test_scoring_writes_everything(spark, tmp_path):
    articles, g, p = small(spark)
    short = {f"A{i}": f"AH-S2C-00{i}" for i in (1, 2, 3)}
    named = lambda df: df.replace(short, subset=["article_id"])
    long = named(p).replace({v: f"{v}_doi" for v in short.values()}, subset=["article_id"])
    out = score(named(articles), named(g), long, tmp_path / "out", "label", 20)
    assert out["main"]["event_level"]["TP"] == 1 and out["articles"]["tp"] == 1
    names = {f.name for f in (tmp_path / "out").iterdir()}
    assert {"main_metrics.json", "vor_matches.csv", "aip_metrics.json", "scoring_lock.json", "article_id_crosswalk.csv"} <= names
    with pytest.raises(FileExistsError):
        score(named(articles), named(g), long, tmp_path / "out", "label", 20)


def test_bootstrap_query_draws_all_replicates(spark, monkeypatch):
    asked, bootstrap = [], E.bootstrap
    monkeypatch.setattr(E, "bootstrap", lambda counts, label, replicates=E.REPLICATES: asked.append(replicates) or bootstrap(counts, label, replicates))
    assert catalog.QUERIES["bootstrap_intervals"](spark, "/root/testdata/sf0.001").count() == 1 and asked == [10_000]


def records_of(rnd, articles, n, words, common=()):
    """n gold and n predicted records an article, some of them near copies."""
    g, p = [], []
    for a in range(articles):
        for i in range(n):
            quote = rnd.choices(words, k=rnd.choice([1, 2, 3, 6, 14])) + [c for c in common if rnd.random() < 0.8]
            term, category = " ".join(quote[:2]), rnd.choice("CD")
            g.append(gold(f"G{a}-{i:03d}", f"A{a}", " ".join(quote), term, category))
            other = [w if rnd.random() < 0.6 else rnd.choice(words) for w in quote]
            p.append(pred(f"P{a}-{i:03d}", f"A{a}", " ".join(other), rnd.choice([term, rnd.choice(words)]), rnd.choice("CD")))
    return g, p


@pytest.mark.parametrize("words, common", [(12, ()), (60, ("heavy", "light", "round", "square")), (400, ("heavy", "light"))])
def test_rare_words_find_every_edge_of_the_product(spark, monkeypatch, words, common):
    g, p = records_of(random.Random(words), 3, 60, [f"w{i}" for i in range(words)], common)
    g, p = spark.createDataFrame(g, GOLD), spark.createDataFrame(p, PRED)
    rows = lambda: sorted(map(tuple, E.edges(g, p).collect()))
    product = rows()
    monkeypatch.setattr(E, "PAIRS", 0)
    assert len(product) > 100 and {r[6] for r in product} == {"route_1", "route_2"} and rows() == product


def test_terms_that_hold_one_another(spark):
    terms = ["a", "ab", "abc", "xabcx", "pain in knee", "in k", "knee", "%", "5%", "zz"]
    df = spark.createDataFrame([("A", t) for t in terms], "article_id string, term string")
    got = {(r.whole, r.part) for r in E.holding_terms(df, df).collect()}
    assert got == {(w, t) for w in terms for t in terms if t in w}


def test_pairs_grow_with_the_records_of_an_article(spark):
    """20,000 records a side that share common words: a few pairs each."""
    rnd = random.Random(8)
    record = lambda i, n: f"w{i}a w{i}b w{i % (n // 4)}c w{i % (n // 3)}d heavy light round {rnd.choice(['x1', 'x2', 'x3'])}"
    sides = {}
    for n in (5_000, 20_000):
        g = spark.createDataFrame([gold(f"G{i}", "A", record(i, n), f"w{i}a") for i in range(n)], GOLD)
        p = spark.createDataFrame([pred(f"P{i}", "A", record(i, n), f"w{i}a") for i in range(n)], PRED)
        sides[n] = g, p
    pairs = {}
    for n, (g, p) in sides.items():
        features = E._features(g, "event_id", "evidence_quote_raw", "event_term_raw", "category_canonical", "g"), E._features(p, "prediction_id", "evidence_quote", "raw_event_term", "predicted_category", "p")
        pairs[n] = E.rare_pairs(*features).count()
    assert 20_000 <= pairs[20_000] < 10 * 20_000 and pairs[20_000] < 6 * pairs[5_000]
    matches = E.greedy(E.edges(*sides[20_000]))
    assert matches.where("substring(event_id, 2) = substring(prediction_id, 2)").count() == matches.count() == 20_000


def test_a_large_article_is_matched_by_components(spark, monkeypatch):
    """Chains, a large component and single edges; and their tasks."""
    rnd = random.Random(6)
    rows = [("A", f"G{i}", f"P{j}", rnd.choice([0.9, 0.5]), 0.5, 0.5) for i in range(9) for j in (i, i + 1)]
    rows += [("A", f"H{rnd.randrange(30)}", f"Q{rnd.randrange(30)}", rnd.choice([0.9, 0.5, 0.1]), rnd.choice([0.1, 0.2]), 0.5) for _ in range(400)]
    rows += [("A", f"S{i}", f"S{i}", 0.5, 0.5, 0.5) for i in range(60)] + [("B", "G1", "P1", 0.5, 0.5, 0.5), ("B", "G1", "P2", 0.4, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "article_id string, event_id string, prediction_id string, rank_score double, quote_jaccard double, term_similarity double").distinct()
    expected = sequential(df.collect())
    monkeypatch.setattr(E, "EDGES", 100)
    assert len([r for r in rows if r[0] == "A"]) > 400
    units = E.match_units(E.written(df, "edges"))
    assert units.where("article_id = 'A'").select("unit").distinct().count() > 60 and units.where("article_id = 'B'").select("unit").distinct().first().unit == 0
    assert sorted((r.article_id, r.event_id, r.prediction_id) for r in E.greedy(df).collect()) == expected


def test_articles_beyond_the_999th_are_scored(spark):
    ids = [f"AH-S2C-{i:03d}" for i in (100, 999, 1000, 12345)]
    articles = spark.createDataFrame([(i,) for i in ids[1:]], "article_id string")
    predicted = spark.createDataFrame([(f"{i}_doi",) for i in ids[:3]], "article_id string")
    kept, missing = E.normalised(predicted, articles)
    assert sorted(r.article_id for r in kept.collect()) == ["AH-S2C-1000", "AH-S2C-999"] and [r.article_id for r in missing.collect()] == ["AH-S2C-12345"]
    assert {tuple(r) for r in E.crosswalk(predicted, articles).collect()} == {(f"{i}_doi", i, i != ids[0]) for i in ids[:3]}
