"""Records against a reference set: matching, metrics, intervals."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.components import connected_components, frequent, lookup
from factloom.operators.written import appended, written

# The normal quantile of the intervals, bootstrap replicates.
Z = 1.959963984540054
REPLICATES = 10_000


#: Articles with more pairs than PAIRS have theirs made from rare shared words;
#: those with more edges than EDGES are matched one component at a time.
PAIRS, EDGES = 1 << 14, 1 << 17

#: The least Jaccard of quotes on either route, and of similar terms' words.
FIRST, SECOND, SIMILAR = (1, 2), (3, 20), (17, 20)


def _features(rows: DataFrame, key: str, quote: str, term: str, category: str, x: str) -> DataFrame:
    return rows.select(
        "article_id", F.col(key).cast("string").alias(key), T.tokens(F.col(quote)).alias(f"{x}_quote"), T.norm(F.col(term)).alias(f"{x}_term"),
        T.tokens(F.col(term)).alias(f"{x}_words"), T.norm(F.col(category)).alias(f"{x}_category"),
    )


def word_pairs(gold: DataFrame, predicted: DataFrame, unit: list[str], least: tuple[int, int]) -> DataFrame:
    """unit, event_id, prediction_id of the pairs of a unit (article, or
    article and term) whose words may have the ``least`` Jaccard; all that have
    it are among them. Both sides are unit, id, words (distinct).

    At a Jaccard of r/s, sets of n and m words have at least r(n + m) / (r + s)
    in common. In a fixed order of a unit's words the first common one
    therefore has as many behind it, itself included, on both sides, which
    rules out the last ones of a set. Words of one side only come first, rare
    ones next, so what is ruled out are the unit's common words. How many are,
    hangs on the partner's size: sizes go by powers of two, and each side gives
    its words once for each power that the other side may have.
    """
    num, den = least
    words = [rows.select(*unit, "id", F.size("words").alias("n"), F.explode("words").alias("word")) for rows in (gold, predicted)]
    g, p = (w.groupBy(*unit, "word").agg(F.count(F.lit(1)).alias(f"n_{x}")) for w, x in zip(words, "gp"))
    shared = written(g.join(p, [*unit, "word"]).select(*unit, "word", (F.col("n_g") * F.col("n_p")).alias("weight")), "shared-words")

    def prefixes(rows: DataFrame, x: str) -> DataFrame:
        n = F.col("n")
        placed = rows.join(shared, [*unit, "word"]).groupBy(*unit, "id", "n").agg(F.array_sort(F.collect_list(F.struct("weight", "word"))).alias("own"))
        # Behind the i-th shared word, itself included, are this many.
        kept = placed.select(*unit, "id", "n", F.size("own").alias("shared"), F.posexplode("own").alias("i", "w")).withColumn("left", F.col("shared") - F.col("i"))
        power = lambda c: F.floor(F.log2(c))
        fewest, most = F.ceil(n * num / den), F.floor(n * den / num)
        dealt = kept.withColumn("other", F.explode(F.sequence(power(fewest), power(most))))
        fewest = F.greatest(fewest, F.expr("shiftleft(1L, CAST(other AS INT))"))
        dealt = dealt.where(F.col("left") * (num + den) >= (n + fewest) * num)
        own, other = power(n), F.col("other")
        sizes = (own.alias("size_g"), other.alias("size_p")) if x == "g" else (other.alias("size_g"), own.alias("size_p"))
        return dealt.select(*unit, F.col("w.word").alias("word"), *sizes, F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("left").alias(f"left_{x}"))

    a, b = (prefixes(w, x) for w, x in zip(words, "gp"))
    sizes = F.least("n_g", "n_p") * den >= F.greatest("n_g", "n_p") * num
    enough = F.least("left_g", "left_p") * (num + den) >= (F.col("n_g") + F.col("n_p")) * num
    found = a.join(b, [*unit, "word", "size_g", "size_p"]).where(sizes & enough)
    return found.select(*unit, F.col("id_g").alias("event_id"), F.col("id_p").alias("prediction_id")).distinct()


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct character n-grams of a text."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (k - 1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(*(F.when(F.length(text) >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in sizes)))


def holding_terms(whole: DataFrame, part: DataFrame) -> DataFrame:
    """article_id, whole, part: terms of an article of which one holds the
    other. What holds a term holds its rarest three characters."""
    grams = written(whole.select("article_id", F.col("term").alias("whole"), F.explode(_grams(F.col("term"), (1, 2, 3))).alias("gram")), "term-grams")
    counts = grams.groupBy("article_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("term") < 3, F.array("term")).otherwise(_grams(F.col("term"), (3,)))
    rarest = part.select("article_id", F.col("term").alias("part"), F.explode(own).alias("gram")).join(counts, ["article_id", "gram"], "left")
    # A gram that no term has rules its own term out.
    rarest = rarest.groupBy("article_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("article_id", "part", "r.gram")
    return grams.join(rarest, ["article_id", "gram"]).where(F.contains("whole", "part")).select("article_id", "whole", "part")


def similar_terms(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """article_id, event_term, term: each term of the events of an article,
    and each of its predictions that is as similar as the second route asks:
    equal, one in the other, or of about the same words."""
    g, p = (written(rows.where(F.col(f"{x}_term") != "").select("article_id", F.col(f"{x}_term").alias("term"), F.col(f"{x}_words").alias("words")).distinct(), "terms") for rows, x in ((gold, "g"), (predicted, "p")))
    sides = [rows.select("article_id", F.col("term").alias("id"), "words") for rows in (g, p)]
    alike = word_pairs(*sides, ["article_id"], SIMILAR).select("article_id", F.col("event_id").alias("event_term"), F.col("prediction_id").alias("term"))
    inside = holding_terms(g, p).select("article_id", F.col("whole").alias("event_term"), F.col("part").alias("term"))
    around = holding_terms(p, g).select("article_id", F.col("part").alias("event_term"), F.col("whole").alias("term"))
    return alike.union(inside).union(around).distinct()


def rare_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """article_id, event_id, prediction_id of all pairs that may be edges:
    for the first route those that share half of their words, for the second
    those of similar terms that share some."""
    g, p = (rows.select("article_id", F.col(key).alias("id"), F.col(f"{x}_term").alias("own"), F.col(f"{x}_quote").alias("words")) for rows, key, x in ((gold, "event_id", "g"), (predicted, "prediction_id", "p")))
    first = word_pairs(g, p, ["article_id"], FIRST)
    terms = written(similar_terms(gold, predicted), "similar-terms")
    named = g.join(terms.withColumnRenamed("event_term", "own"), ["article_id", "own"])
    second = word_pairs(named, p.withColumnRenamed("own", "term"), ["article_id", "term"], SECOND).drop("term")
    return first.union(second).distinct()


def near_records(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of records of an article, all edges among them: the product in
    small articles, rare_pairs in large ones."""
    counts = [rows.groupBy("article_id").agg(F.count(F.lit(1)).alias(n)) for rows, n in ((gold, "n_g"), (predicted, "n_p"))]
    large = written(counts[0].join(counts[1], "article_id").where(F.col("n_g") * F.col("n_p") > PAIRS).select("article_id"), "large-articles")
    if large.isEmpty():
        return gold.join(predicted, "article_id")
    (g, large_g), (p, large_p) = ((rows.join(large, "article_id", "left_anti"), rows.join(large, "article_id", "left_semi")) for rows in (gold, predicted))
    pairs = rare_pairs(large_g, large_p).join(large_g, ["article_id", "event_id"]).join(large_p, ["article_id", "prediction_id"])
    return g.join(p, "article_id").unionByName(pairs)


def edges(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of the same article that may be the same event, with features.

    gold: event_id, article_id, evidence_quote_raw, event_term_raw,
    category_canonical. predicted: prediction_id, article_id, evidence_quote,
    raw_event_term, predicted_category. Normal forms and word sets are made
    once per record, and written before the join.
    """
    g = written(_features(gold, "event_id", "evidence_quote_raw", "event_term_raw", "category_canonical", "g"), "events")
    p = written(_features(predicted, "prediction_id", "evidence_quote", "raw_event_term", "predicted_category", "p"), "predictions")
    quote, term, same = F.col("quote_jaccard"), F.col("term_similarity"), F.col("category_exact")
    first, second = (quote >= 0.5) & ((term >= 0.5) | same), (term >= 0.85) & (quote >= SECOND[0] / SECOND[1])
    similar = T.similarity_of(F.col("g_term"), F.col("p_term"), T.set_jaccard(F.col("g_words"), F.col("p_words")))
    # Either route wants one of these two, which are cheaper than the quotes.
    alike = (F.col("g_category") == F.col("p_category")) | (similar >= 0.5)
    near = near_records(g, p).where(alike).withColumn("quote_jaccard", T.set_jaccard(F.col("g_quote"), F.col("p_quote"))).where(quote >= SECOND[0] / SECOND[1])
    scored = near.withColumn("category_exact", F.col("g_category") == F.col("p_category")).withColumn("term_similarity", similar).where(first | second)
    # The order of these additions decides ties in the last bit.
    rank = F.lit(0.60) * quote + F.lit(0.30) * term + F.lit(0.10) * same.cast("double")
    return scored.select("article_id", "event_id", "prediction_id", "quote_jaccard", "term_similarity", "category_exact", F.when(first, "route_1").otherwise("route_2").alias("route"), rank.alias("rank_score"))


def match_units(rows: DataFrame) -> DataFrame:
    """``rows`` (written edges) with ``unit``: rows of different units have no
    record in common. It is 0 for small articles, and in large ones names the
    connected component of the article's records."""
    zero = F.lit(0).cast("long").alias("unit")
    large = written(rows.groupBy("article_id").count().where(F.col("count") > EDGES).select("article_id"), "large-articles")
    if large.isEmpty():
        return rows.select("*", zero)
    event, record = (F.xxhash64(F.lit(side), "article_id", key) for side, key in (("g", "event_id"), ("p", "prediction_id")))
    many = rows.join(large, "article_id", "left_semi").withColumn("node", event)
    labels = connected_components(many.select(F.col("node").alias("a"), record.alias("b")))
    units = lookup(many, labels.withColumnRenamed("label", "unit"), "node", frequent(many, "node")).drop("node")
    return rows.join(large, "article_id", "left_anti").select("*", zero).unionByName(units)


def greedy(candidates: DataFrame) -> DataFrame:
    """One-to-one matches of an article's edges, best first: by rank_score,
    quote_jaccard, term_similarity, then the ids as text. Rows of candidates
    must have article_id, event_id, prediction_id and those three.

    What is taken in one component of the match graph says nothing about
    another, so a large article is as many units as it has components. Spark
    brings a unit's edges together and in order, spilling as it needs; one pass
    over them holds no edge, only the ids the current unit has used. (Taking
    mutually best edges in distributed rounds was tried: n equal records on
    both sides then need n rounds.)
    """
    order = [F.col(c).desc() for c in ("rank_score", "quote_jaccard", "term_similarity")] + [F.col("event_id"), F.col("prediction_id")]
    units = match_units(written(candidates, "edges"))
    ordered = units.repartition("article_id", "unit").sortWithinPartitions("article_id", "unit", *order)

    def run(batches):
        current, events, records = None, set(), set()
        for batch in batches:
            keep = []
            for *unit, e, p in zip(*(batch.column(c).to_pylist() for c in ("article_id", "unit", "event_id", "prediction_id"))):
                if unit != current:
                    current, events, records = unit, set(), set()
                free = e not in events and p not in records
                if free:
                    events.add(e)
                    records.add(p)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, units.schema).drop("unit")


def eligible_ids(articles: DataFrame) -> DataFrame:
    return articles.where(F.lower(F.trim("eligible")) == "yes").select(F.trim("article_id").alias("article_id")).distinct()


def outcomes(articles: DataFrame, gold: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """matches, false positives, false negatives. Predictions of articles
    that are not eligible don't count; reference events of theirs do."""
    used = predicted.join(eligible_ids(articles), "article_id", "left_semi")
    matches = written(greedy(edges(gold, used)), "matches")
    positives = used.join(matches.select("prediction_id"), "prediction_id", "left_anti")
    return matches, positives, gold.join(matches.select("event_id"), "event_id", "left_anti")


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def wilson(success: Column, total: Column) -> Column:
    """struct<low, high> of the 95% interval; nulls for no trials."""
    n, p, z2 = total.cast("double"), ratio(success, total), Z * Z
    centre = p + z2 / (n * 2)
    half = F.lit(Z) * F.sqrt((p * (1 - p) + z2 / (n * 4)) / n)
    shrink = 1 + z2 / n
    some = total > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), centre / shrink - half / shrink)).alias("low"), F.when(some, F.least(F.lit(1.0), centre / shrink + half / shrink)).alias("high"))


def f1(precision: Column, recall: Column, default: float | None = None) -> Column:
    return ratio(precision * recall * 2, precision + recall, default)


def event_metrics(matches: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row: TP, FP, FN, precision, recall, f1 (0 where undefined), and
    Wilson intervals."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # Three tables of one row each.
    counts = count(matches, "tp").join(count(positives, "fp")).join(count(negatives, "fn"))
    c, found, known = F.col, F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    rated = counts.select("*", ratio(c("tp"), found, 0.0).alias("precision"), ratio(c("tp"), known, 0.0).alias("recall"))
    return rated.select("*", f1(c("precision"), c("recall"), 0.0).alias("f1"), wilson(c("tp"), found).alias("precision_ci95"), wilson(c("tp"), known).alias("recall_ci95"))


def article_counts(articles: DataFrame, matches: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """tp, fp, fn of each eligible article, 0 where it has none."""
    out = eligible_ids(articles)
    for name, rows in (("tp", matches), ("fp", positives), ("fn", negatives)):
        out = out.join(rows.groupBy("article_id").agg(F.count(F.lit(1)).alias(name)), "article_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def seeded(label: str) -> dict:
    """The state of Python's Mersenne Twister that the first 64 bits of the
    label's SHA-256 seed, as numpy takes it."""
    _, (*key, at), _ = random.Random(int(hashlib.sha256(label.encode()).hexdigest()[:16], 16)).getstate()
    return {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}


def drawn(twister: np.random.MT19937, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """What the next ``words`` words of the sequence give to ``randrange(n)``:
    the leading bits of each, as many as n has, and whether they are a place
    below n. Those that aren't are passed over."""
    places = twister.random_raw(words) >> np.uint64(32 - n.bit_length())
    return places, places < n


def replicate_states(n: int, label: str, replicates: int, each: int = 100, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes, int, int]]:
    """Where the draws of every ``each``-th replicate of n places begin:
    (first replicate, replicates, key and position of the generator, words to
    skip). How many words a replicate takes is known only by looking at them,
    so this passes over the sequence once, keeping none of it."""
    twister, seen, first = np.random.MT19937(), 0, 0
    twister.state = seeded(label)
    while first < replicates:
        state = twister.state["state"]
        fit = np.flatnonzero(drawn(twister, n, step)[1])
        while first < replicates and first * n <= seen + len(fit):
            used = first * n - seen  # places of this step that are drawn before
            yield first, min(each, replicates - first), state["key"].tobytes(), int(state["pos"]), int(fit[used - 1]) + 1 if used else 0
            first += each
        seen += len(fit)


def replicate_places(n: int, replicates: int, key: bytes, position: int, skip: int, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, places) of a state: some or all of the n places of one
    replicate after another, ``block`` words at a time."""
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, np.uint32), "pos": position}}
    twister.random_raw(skip)
    at, left = 0, n
    while at < replicates:
        places, fit = drawn(twister, n, min(block, max(1024, 2 * n * replicates)))
        places = places[fit].astype(np.int64)
        while len(places) and at < replicates:
            yield at, places[:left]
            places, left = places[left:], left - min(left, len(places))
            if not left:
                at, left = at + 1, n


def replicate_sums(counts: DataFrame, seed_label: str, replicates: int = REPLICATES, chunk: int = 1 << 20) -> DataFrame:
    """replicate, tp, fp, fn: the sums over the articles that each replicate
    draws, of ``counts`` (article_id, tp, fp, fn); no row without an article.

    The draws are one seeded sequence over the articles in the order of their
    ids. One task passes over it and writes the generator's state before every
    hundredth replicate; from these, tasks draw independently. They get the
    counts in chunks of at most ``chunk`` articles, one after another, and
    sum the draws that fall into it.
    """
    names = ("tp", "fp", "fn")
    spark = counts.sparkSession
    ordered = written(counts.select("article_id", *(F.col(c).cast("long").alias(c) for c in names)).orderBy("article_id"), "bootstrap-counts")
    n = ordered.count()
    schema = "replicate long, tp long, fp long, fn long"
    if not n:
        return spark.createDataFrame([], schema)

    def states(_):
        for row in replicate_states(n, seed_label, replicates):
            yield pa.record_batch([pa.array([v]) for v in row], names=["first", "replicates", "key", "position", "skip"])

    starts = spark.range(1, numPartitions=1).mapInArrow(states, "first long, replicates long, key binary, position long, skip long")
    starts = written(starts, "bootstrap-states").repartition(max(1, min(-(-replicates // 100), 4 * spark.sparkContext.defaultParallelism)))

    def scan(shared) -> DataFrame:
        def run(batches):
            low, values = shared.value
            for batch in batches:
                for first, *state in zip(*(c.to_pylist() for c in batch.columns)):
                    sums = np.zeros((state[0], 3), np.int64)
                    for at, places in replicate_places(n, *state):
                        places = places[(places >= low) & (places < low + values.shape[1])] - low
                        sums[at] += values[:, places].sum(1)
                    yield pa.record_batch([pa.array(c) for c in (first + np.arange(state[0]), *sums.T)], names=["replicate", *names])

        return starts.mapInArrow(run, schema)

    def parts() -> Iterator[DataFrame]:
        for low, values in _chunks(ordered, names, chunk):
            shared = spark.sparkContext.broadcast((low, values))
            yield scan(shared)
            shared.destroy()

    sums = appended(spark, parts(), schema, "bootstrap-sums")
    return sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in names))


def _chunks(ordered: DataFrame, names: tuple[str, ...], chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    """The first place and the columns of every ``chunk`` rows of a table
    that is written in order; the driver holds one chunk."""
    low, held = 0, []
    for row in ordered.orderBy("article_id").select(*names).toLocalIterator():
        held.append(tuple(row))
        if len(held) == chunk:
            yield low, np.array(held, np.int64).T
            low, held = low + chunk, []
    if held:
        yield low, np.array(held, np.int64).T


def bootstrap(counts: DataFrame, seed_label: str, replicates: int = REPLICATES) -> DataFrame:
    """Percentile intervals (2.5%, 97.5%) of precision, recall and f1 when
    the articles of counts (article_id, tp, fp, fn) are drawn anew: one row."""
    c = F.col
    sums = replicate_sums(counts, seed_label, replicates)
    rated = sums.select(ratio(c("tp"), c("tp") + c("fp"), 0.0).alias("precision"), ratio(c("tp"), c("tp") + c("fn"), 0.0).alias("recall")).withColumn("f1", f1(c("precision"), c("recall"), 0.0))
    return rated.agg(*(F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in ("precision", "recall", "f1")))


#: Metric -> gold column, predicted column, comparison, gold blanks left out.
FIELDS = {
    "category_canonical_exact": ("category_canonical", "predicted_category", "norm", False),
    "numerator_value_exact": ("numerator_value", "numerator", "number", True),
    "denominator_value_exact": ("denominator_value", "denominator", "number", True),
    "arm_raw_exact": ("arm_raw", "arm", "norm", True),
    "arm_canonical_exact": ("arm_canonical", "arm", "arm", True),
    "time_raw_exact": ("time_raw", "time_window", "norm", True),
    "time_canonical_exact": ("time_canonical", "time_window", "time", True),
    "poolability_exact": ("poolability", "poolability", "norm", False),
}


def accuracy(correct: Column, eligible: Column) -> Column:
    return F.struct(correct.alias("correct"), eligible.alias("eligible"), ratio(correct, eligible).alias("accuracy"), wilson(correct, eligible).alias("ci95"))


def field_metrics(matches: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of accuracy structs, by one pass over the matched pairs. A
    blank predicted value is wrong, not left out."""
    g = gold.select("event_id", *(F.col(f[0]).cast("string").alias(f"g_{name}") for name, f in FIELDS.items()))
    p = predicted.select("prediction_id", *(F.col(f[1]).cast("string").alias(f"p_{name}") for name, f in FIELDS.items()))
    pairs = matches.select("event_id", "prediction_id").join(g, "event_id").join(p, "prediction_id")

    def same(name: str, how: str) -> Column:
        a, b = F.col(f"g_{name}"), F.col(f"p_{name}")
        if how == "number":
            return F.coalesce(T.numeric_equal(a, b), F.lit(False))
        return T.norm(a) == {"norm": T.norm, "arm": T.canonical_arm, "time": lambda x: T.norm(T.canonical_time(x))}[how](b)

    sums = []
    for name, (_, _, how, needed) in FIELDS.items():
        counts = (F.trim(F.coalesce(f"g_{name}", F.lit(""))) != "") if needed else F.lit(True)
        sums += [F.count_if(counts & same(name, how)).alias(f"c_{name}"), F.count_if(counts).alias(f"n_{name}")]
    return pairs.agg(*sums).select(*(accuracy(F.col(f"c_{n}"), F.col(f"n_{n}")).alias(n) for n in FIELDS))


def article_signals(articles: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row per eligible article: is it positive in the reference, has it a
    prediction, and the class of that."""
    gold = F.lower(F.trim("harms_status")).isin("yes", "unclear")
    some = predicted.select("article_id").distinct().withColumn("_some", F.lit(True))
    rows = articles.where(F.lower(F.trim("eligible")) == "yes").join(some, "article_id", "left")
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce("_some", F.lit(False))
    kind = F.when(g & p, "TP").when(~g & p, "FP").when(g & ~p, "FN").otherwise("TN")
    return rows.select("article_id", "publication_version", "harms_status", g.alias("gold_positive"), p.alias("predicted_positive"), kind.alias("classification"))


def confusion(signals: DataFrame) -> DataFrame:
    """One row of the confusion matrix and its rates; null if undefined."""
    counted = signals.agg(F.count(F.lit(1)).alias("articles"), *(F.count_if(F.col("classification") == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    parts = {"sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp), "precision": (tp, tp + fp), "accuracy": (tp + tn, F.col("articles"))}
    rated = counted.select("*", *(ratio(a, b).alias(k) for k, (a, b) in parts.items()), *(wilson(a, b).alias(f"{k}_ci95") for k, (a, b) in parts.items()))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("sensitivity")))


def flat_matches(matches: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    g = gold.select("event_id", F.col("event_term_raw").alias("gold_event_term"), F.col("category_canonical").alias("gold_category"), F.col("evidence_quote_raw").alias("gold_evidence_quote"))
    p = predicted.select("prediction_id", F.col("raw_event_term").alias("predicted_event_term"), "predicted_category", F.col("evidence_quote").alias("predicted_evidence_quote"))
    joined = matches.join(g, "event_id").join(p, "prediction_id")
    return joined.select(
        "event_id", "prediction_id", "article_id", "route", "rank_score", "quote_jaccard", "term_similarity", "category_exact",
        "gold_event_term", "predicted_event_term", "gold_category", "predicted_category", "gold_evidence_quote", "predicted_evidence_quote",
    )


def subset(articles: DataFrame, gold: DataFrame, predicted: DataFrame, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables, for the articles of one publication version."""
    kept = articles.where(F.col("publication_version") == version)
    return kept, *(df.join(kept.select("article_id"), "article_id", "left_semi") for df in (gold, predicted))


def crosswalk(predicted: DataFrame, articles: DataFrame) -> DataFrame:
    """Each long article id of the predictions, its short one, and whether
    that is among the articles."""
    ids = predicted.select(F.col("article_id").alias("sealed_article_id")).distinct()
    short = ids.withColumn("normalized_article_id", T.short_article_id(F.col("sealed_article_id")))
    known = articles.select(F.col("article_id").alias("normalized_article_id"), F.lit(True).alias("_in")).distinct()
    return short.join(known, "normalized_article_id", "left").select("sealed_article_id", "normalized_article_id", F.coalesce("_in", F.lit(False)).alias("in_main"))


def normalised(predicted: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The predictions of the articles under their short ids, and the
    articles that have none."""
    named = predicted.withColumnRenamed("article_id", "sealed_article_id").withColumn("article_id", T.short_article_id(F.col("sealed_article_id")))
    kept = named.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    return kept, articles.select("article_id").join(kept.select("article_id"), "article_id", "left_anti")
