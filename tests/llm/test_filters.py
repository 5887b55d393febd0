"""Decontamination, quality, language, secrets."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import automata, decontamination, language, quality, secrets

from .brute import AWKWARD, SCHEMA, awkward

ITEMS = "item_id long, text string, extra string"


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_hits(docs, items, k, t):
    """Items of fewer than k words are sought as they are, at their width."""

    def grams(w, width):
        return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}

    sets = {}
    for i, text in items:
        w = plain_words(text)
        if w and i is not None:
            sets[i] = min(k, len(w)), grams(w, min(k, len(w)))
    out = []
    for d, text in docs:
        w = plain_words(text)
        of = {width: grams(w, width) for width, _ in sets.values()}
        out += [(d, i, len(of[width] & q), len(q)) for i, (width, q) in sets.items() if len(of[width] & q) >= t * len(q)]
    return sorted(out, key=str)


def contaminated_case(seed, n_items=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 12, 40])))) for i in range(n_items)] + [(None, "a b c d e f"), (900, None), (901, " ... ")]
    docs = []
    for d in range(120):
        parts = rnd.choices(words, k=rnd.choice([0, 3, 300]))
        for _ in range(rnd.choice([0, 0, 1, 2, 40])):
            w = items[rnd.randrange(n_items)][1].split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "changed"
            parts += [w[0].upper() + ",", *w[1:]]
        docs.append((d, " ".join(parts)))
    return docs + [(500, " ".join(t for _, t in items if t)), (501, None)], items


@pytest.mark.parametrize("seed, search", [(1, {}), (2, {"block": 100}), (3, {"max_bands": 0}), (4, {"containment": 0.5, "k": 3}), (5, {"bits": 8, "max_bands": 20})])
def test_contained_items_equal_brute_force(spark, seed, search):
    docs, items = contaminated_case(seed)
    s = decontamination.Search(**search)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    rows = decontamination.contaminated(df, bench, s).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in rows), key=str) == plain_hits(docs, items, s.k, s.containment)
    bad = {r.doc_id for r in rows}
    assert {r.doc_id for r in decontamination.clean_documents(df, bench, s).collect()} == {d for d, _ in docs} - bad


def test_a_short_item_leaves_the_bands_of_others():
    rng, search = np.random.default_rng(1), decontamination.Search()
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (40, 50, 60)]
    long, both = decontamination.ItemIndex(search, [0, 1, 2], sets), decontamination.ItemIndex(search, [0, 1, 2, 3], [*sets, sets[0][:1]])
    for n in (1, 30, 60, 200, 300):
        assert long.table(n)[0] == both.table(n)[0] or n == 1
        assert long.table(n)[3] == [k for k in both.table(n)[3] if k]
    reduced = np.unique(np.concatenate([sets[0], sets[1][:30], rng.integers(0, 1 << 63, 100, np.uint64)]))
    assert both.table(len(reduced))[0] > 0 and both.table(len(reduced))[3] == [0]
    assert [h[0] for h in both.hits(reduced)] == [0, 3] and 0 in both.candidates(both.reduce(reduced))


def test_bands_miss_little():
    search = decontamination.Search()
    for part in range(12):
        for kind in range(12):
            bands = decontamination.bands_of(part, kind, search)
            q, x = (1 << kind >> 1) + 1 if kind else 1, 1 << part
            shared = min(x, search.containment * q)
            if bands and search.containment * q <= x:
                assert (1 - shared / (q + x - shared)) ** bands <= search.miss * 1.0001


def test_short_items_are_found_inside_long_documents(spark):
    """Items of one to four words, in order and in a row; other documents
    stay."""
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, f"{filler} Quantum tomato -- flies\nbackwards {filler}"), (2, f"{filler} tomato quantum flies backwards"), (3, "quantum tomato flies"), (4, f"one {filler} TWO three"), (5, "xylophone"), (6, filler), (7, "")]
    items = [(10, "quantum tomato flies backwards"), (11, "Two, three"), (12, "xylophone"), (13, "tomato flies"), (14, "f1 f2 f3 f5"), (15, "f0 f1 f2 f3 f4 f5")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(1, 10), (1, 13), (3, 13), (4, 11), (5, 12), (1, 15), (2, 15), (4, 15), (6, 15)}
    assert [r.doc_id for r in decontamination.clean_documents(df, bench.where("item_id < 15")).orderBy("doc_id").collect()] == [2, 6, 7]


def test_items_without_id_are_cleaned(spark):
    docs = spark.createDataFrame([(1, "x " * 9 + "a b c d e f g", None, None, None), (2, "x " * 9 + "h i j k l m n", None, None, None), (3, "x " * 9, None, None, None)], SCHEMA)
    bench = spark.createDataFrame([(None, "A b c d e f g", ""), (None, "h i j k l m n", ""), (None, None, ""), (7, "a b c d e f g", "")], ITEMS)
    rows = [tuple(r) for r in decontamination.contaminated(docs, bench).collect()]
    assert rows == [(1, 7, 3, 3, 1.0)]
    assert [r.doc_id for r in decontamination.clean_documents(docs, bench).collect()] == [3]


def test_nothing_to_find(spark):
    bench = spark.createDataFrame([], ITEMS)
    assert decontamination.contaminated(awkward(spark), bench).collect() == []
    assert decontamination.clean_documents(awkward(spark), bench).count() == len(AWKWARD)
    some = spark.createDataFrame([(1, "the same row", None)], ITEMS)
    assert [r.doc_id for r in decontamination.contaminated(awkward(spark), some).collect()] == [4, 4]
    assert decontamination.contaminated(awkward(spark).where("false"), some).collect() == []


def prose(rnd, good):
    w = ["".join(rnd.choices("aeiounrst", k=rnd.randrange(2, 9))) for _ in range(rnd.randrange(20, 200))]
    return " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w) if rnd.random() < 0.5 else " ".join(w[:3] * 30)


def labelled(spark, n=400):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, i % 4 > 0), None, "s", 1) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(3, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality.score_quality(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert 80 < len(held) < 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.97
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda df, lab: {r.doc_id: round(r.score, 9) for r in quality.score_quality(df, lab).collect()}
    assert scores(docs, labels) == scores(docs.withColumns({"source": F.lit("z"), "lang": F.lit("q")}), flipped)


def test_quality_of_awkward_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(awkward(spark), labels).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert len(quality.score_quality(awkward(spark), one).collect()) == len(AWKWARD)
    assert quality.score_quality(awkward(spark).where("false"), one).collect() == []


def plain_quality(docs, labels, shrinkage=0.1):
    """Scores by class densities over plain sums, all documents in memory."""
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs}
    of = {k: np.array([x[i] for i, q in labels if q == k and i in x and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)}
    n = {k: len(v) for k, v in of.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in of.items()}
    pooled = sum(n[k] * np.diag(cov[k]) for k in (0, 1)) / sum(n.values()) + 1e-6
    logs = {}
    for k in (0, 1):
        s = (1 - shrinkage) * cov[k] + shrinkage * np.diag(pooled)
        inverse, mean = np.linalg.inv(s), of[k].mean(0)
        logs[k] = {i: np.log(n[k] / sum(n.values())) - 0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * np.linalg.slogdet(s)[1] for i, v in x.items()}
    return {i: 1 / (1 + np.exp(np.clip((logs[0][i] - logs[1][i]) / len(v), -500, 500))) for i, v in x.items()}


def test_quality_equals_a_plain_version(spark):
    docs, labels = labelled(spark, 300)
    rows = quality.score_quality(docs, labels).collect()
    expected = plain_quality([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    assert len(rows) == 300 and all(r.score == pytest.approx(expected[r.doc_id], rel=1e-5, abs=1e-9) for r in rows)


def test_a_bounded_sample_of_labels_will_do(spark):
    docs, labels = labelled(spark)
    assert quality.training_rows(labels, 90).count() == 90
    rows = quality.score_quality(docs, labels, sample=90).collect()
    assert len(rows) == 400 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in rows]) > 0.95


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (50, 3)), rng.normal(1, 2, (30, 3))]
    model = quality.discriminant(np.array([50.0, 30.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0)
    point = rng.normal(0, 1, (5, 3))
    logs = []
    for a, prior in zip(x, (50 / 80, 30 / 80)):
        c = np.cov(a.T, bias=True)
        d = point - a.mean(0)
        logs.append(np.log(prior) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)))
    assert model.scores(point) == pytest.approx(1 / (1 + np.exp((logs[0] - logs[1]) / 3)), rel=1e-6)


SYLLABLES = {"xx": ["ba", "be", "bo"], "yy": ["ki", "ku", "ke"], "zz": ["lö", "lü", "la"], "qq": ["mar", "ter", "son"]}


def spoken(rnd, lang):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=3)) for _ in range(rnd.randrange(3, 60)))


def test_language(spark):
    rnd = random.Random(1)
    rows = [(i, spoken(rnd, lang := sorted(SYLLABLES)[i % 4]), lang, "s", 1) for i in range(300)]
    rows += [(1000, "123 !!", "xx", "s", 1), (1001, None, "xx", "s", 1), (1002, spoken(rnd, "xx"), None, "s", 1), (None, spoken(rnd, "yy"), "yy", "s", 1)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by_id[i].lang_pred == sorted(SYLLABLES)[i % 4] for i in range(300))
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001)] == [("und", 0.0)] * 2
    assert by_id[1002].lang_pred == "xx" and by_id[None].lang_pred == "yy" and not by_id[None].held_out
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    _, score, unsure = model.decode(np.array([np.concatenate(language.ngrams(t)) for t in (spoken(rnd, "xx") + " " + spoken(rnd, "xx"), "bakibekubo kibakubeke")]))
    assert not unsure[0] and score[1] < score[0]


def test_numbers_are_no_letters(spark):
    rows = [(i, spoken(random.Random(i), "xx" if i % 2 else "yy"), "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    rows += [(100 + i, t, "xx", "s", 1) for i, t in enumerate(("½ ② Ⅷ", "12 _ ¼", "\u0301", "", "² ª"))]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[100 + i] for i in range(4)] == ["und"] * 4 and got[104] != "und"


def plain_grams(text):
    b = b" " + text.lower().encode().translate(language.FOLD) + b" "
    b = bytes(x for i, x in enumerate(b) if x != 32 or i == 0 or b[i - 1] != 32)
    out = {}
    for n, times in ((2, 2246822519), (3, 2654435761)):
        for i in range(len(b) - n + 1):
            slot = (int.from_bytes(b[i : i + n], "big") * times) % (1 << 32) >> 19
            key = slot + (8192 if n == 3 else 0)
            out[key] = out.get(key, 0) + 1
    return out


def plain_codes(train, texts):
    """Codewords, weights and losses by loops: (language, score) of texts."""
    sums = {}
    for text, lang in train:
        grams = plain_grams(text)
        scale = min(1.0, 1000 / sum(grams.values()))
        of = sums.setdefault(lang, [0.5] * language.DIMENSIONS)
        for g, n in grams.items():
            of[g] += n * scale
    names = sorted(sums)
    rates = [[v / sum(sums[x]) for v in sums[x]] for x in names]
    code = [[1] * (2 ** (len(names) - 1) - 1)] + [[-1 if b >> i & 1 else 1 for b in range(1, 2 ** (len(names) - 1))] for i in range(len(names) - 1)]
    bits = []
    for b in range(len(code[0])):
        sides = {s: [i for i in range(len(names)) if code[i][b] == s] for s in (1, -1)}
        mean = {s: [sum(rates[i][g] for i in of) / len(of) for g in range(language.DIMENSIONS)] for s, of in sides.items()}
        weight = [math.log(u) - math.log(v) for u, v in zip(mean[1], mean[-1])]
        out = [sum(r * w for r, w in zip(row, weight)) for row in rates]
        high, low = (sum(out[i] for i in sides[s]) / len(sides[s]) for s in (1, -1))
        bits.append((weight, (high + low) / 2, max((high - low) / 2, 1e-6)))
    whole, found = sum(h for _, _, h in bits), []
    for text in texts:
        grams = plain_grams(text)
        n = sum(grams.values())
        margins = [(sum(c / n * w[g] for g, c in grams.items()) - m) / h for w, m, h in bits]
        loss = [sum(math.log1p(math.exp(-2 * min(3, max(-3, m)) * code[i][b])) * bits[b][2] / whole for b, m in enumerate(margins)) for i in range(len(names))]
        likely = [math.exp(-8 * (x - min(loss))) for x in loss]
        found.append((names[loss.index(min(loss))], max(likely) / sum(likely)))
    return found


@pytest.mark.parametrize("names", [["xx", "yy"], ["xx", "yy", "zz"], ["xx", "yy", "zz", "qq"]])
def test_output_codes_equal_a_plain_version(spark, names):
    rnd = random.Random(len(names))
    rows = [(i, spoken(rnd, names[i % len(names)]) * rnd.choice([1, 60]), names[i % len(names)], "s", 1) for i in range(60)]
    rows += [(100 + i, spoken(rnd, rnd.choice(names)) + " " + spoken(rnd, rnd.choice(names)), None, "s", 1) for i in range(30)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = plain_codes([(t, lang) for i, t, lang, _, _ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2], [r[1] for r in rows])
    for row, (lang, score) in zip(rows, expected):
        assert got[row[0]].score == pytest.approx(score, abs=1e-3)
        assert got[row[0]].lang_pred == lang or score < 0.51


def test_language_with_nothing_or_one_to_learn(spark):
    none = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(awkward(spark).withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}
    assert language.identify(none.where("false")).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 20])
def test_codewords_are_distinct_and_every_bit_splits(n):
    code = language.codewords(n)
    assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(0)) < n).all()


def test_base_spans():
    kinds = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 0, 20),
        "hex": (r"[0-9a-f]+", 0, 0, 24),
    }
    rnd = random.Random(3)
    parts = ["token", "TOKEN", "ſecret", "secret", "api_key", "apikey", "=", ":", " ", "  ", "\n", "'", '"', "abc", "AKIA", "A" * 9, "0a1b2c3d4e5f" * 2, "f" * 13, "xyz123", "=", "é", "😀", "-", "password"]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        expected = sorted((m.start(), i, m.end()) for i, (p, flags, g, least) in enumerate(kinds.values()) for m in re.finditer(p, t, flags) if len(m[g]) >= least)
        assert secrets.base_spans(t) == expected, t


def test_secrets_found_by_format(spark):
    rnd = random.Random(5)
    hexes = lambda: "".join(rnd.choices("0123456789abcdef", k=40))
    keys = lambda: "AKIA" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    rows = [(i, f"words here token = '{hexes()}' and {keys()} then antidisestablishmentarianism", None, None, 1) for i in range(200)]
    hidden = hexes().upper()[:39] + "0"
    split = hexes()[:20] + "-" + hexes()[:19]
    rows += [(900, f"plain {split} end", None, None, 1), (901, "a wonderful-and-perfectly-ordinary-hyphenation", None, None, 1), (902, hidden, None, None, 1)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    r = got[0]
    assert (r.n_assign, r.n_access, r.n_hex, r.n_grammar) == (1, 1, 1, 0)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.spans.startswith("assign:11:")
    assert got[900].n_hex == 0 and got[900].spans == f"grammar:6:{6 + len(split)}" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[901].spans == ""


FORMATS = {
    "no digit": lambda pick: pick("ABCDEF", 30),
    "short": lambda pick: "k9-" + pick("0123456789", 8),
    "long": lambda pick: "eyJ" + pick("0123456789ABCDEF", 150) + "." + pick("0123456789ABCDEF", 300),
}


@pytest.mark.parametrize("name", FORMATS)
def test_secrets_of_any_length_and_characters(spark, name):
    rnd = random.Random(6)
    make = lambda: FORMATS[name](lambda letters, n: "".join(rnd.choices(letters, k=n)))
    plain = lambda: " ".join("".join(rnd.choices("aeiounrst", k=rnd.randrange(6, 26))) for _ in range(5))
    rows = [(i, f"{plain()} token = '{make()}' {plain()}", None, None, 1) for i in range(100)]
    hidden = make()
    rows += [(900, f"plain {hidden} end", None, None, 1), (901, f"{plain()} remarkable-and-ordinary", None, None, 1)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[900].spans == f"grammar:6:{6 + len(hidden)}" and got[901].spans == ""
    assert all(got[i].n_assign == 1 and got[i].n_grammar == 0 for i in range(100))


def test_a_value_of_two_kinds_teaches_both():
    text = "token = " + "0123456789abcdef" * 2
    assert sorted(k for _, k in secrets._scan(text)[1]) == [0, 2]


def test_secrets_beside_claimed_parts(spark):
    rnd = random.Random(7)
    key = lambda: "AKIA" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    make = lambda: "s7" + "".join(rnd.choices("0123456789abcdefABCDEF", k=30))
    plain = lambda: " ".join("".join(rnd.choices("aeiounrst", k=rnd.randrange(6, 26))) for _ in range(5))
    rows = [(i, f"{plain()} token = {make()} {plain()}", None, None, 1) for i in range(100)]
    rows += [(900, f"see {key()}/{make()}", None, None, 1), (901, f"{make()}/{key()}//{make()}.{key()}/short", None, None, 1)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[900].spans.split(",")[1:] == ["grammar:25:57"] and got[900].n_access == 1
    assert [s for s in got[901].spans.split(",") if s.startswith("grammar")] == ["grammar:0:32", f"grammar:{32 + 1 + 20 + 2}:{32 + 1 + 20 + 2 + 32}"]


def test_secrets_of_awkward_documents(spark):
    rows = {r.doc_id: r for r in secrets.scan_secrets(awkward(spark)).collect()}
    assert rows[1].spans == "" and rows[6].n_assign == 1 and rows[6].n_access == 1
    assert secrets.scan_secrets(awkward(spark).where("false")).collect() == []


def test_automaton_learns_a_format():
    rnd = random.Random(1)
    words = ["k-" + "".join(rnd.choices("0123456789", k=6)) for _ in range(200)]
    a = automata.infer(words)
    assert len(a.steps) < 30
    assert a.score("k-123456") > -3.5 > a.score("k-12xy56") and a.score("hello") < -5
    assert automata.infer([]) is None


def test_long_words_teach_all_their_characters():
    words = ["ab" * 150 + "x" * n for n in range(50, 90)]
    long, cut = automata.infer(words), automata.infer([w[:200] for w in words])
    assert long.score("ab" * 100 + "x" * 60) > cut.score("ab" * 100 + "x" * 60) + 1


def test_a_prefixed_format_is_found_and_words_are_not(spark):
    rnd = random.Random(8)
    make = lambda: "sk-" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24))
    plain = lambda: " ".join("".join(rnd.choices("aeiounrst", k=rnd.randrange(6, 26))) for _ in range(5))
    rows = [(i, f"{plain()} token = '{make()}' {plain()}", None, None, 1) for i in range(200)] + [(900 + i, f"plain {make()} {plain()}", None, None, 1) for i in range(50)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    found = [s for r in got for s in r.spans.split(",") if s.startswith("grammar")]
    assert len(found) >= 43 and set(found) == {"grammar:6:33"}
