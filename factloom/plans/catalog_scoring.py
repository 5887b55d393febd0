"""Queries of evaluation, selection and governance.

Events and predictions, candidate lists and files are made from orders, parts
and suppliers, so that SQL can say what must come out. Every query runs over
its whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation as E
from factloom.operators import governance as G
from factloom.operators import selection
from factloom.operators.written import folder
from factloom.plans import queueing
from factloom.plans.catalog import SEED, bootstrap_sql, query, queue_sql, table
from factloom.plans.catalog_articles import pick, text
from factloom.plans.scoring import score
from factloom.sources import sinks, tabular
from factloom.sources.store import Place, read_json, sha256

# ---- events against a reference ----


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles: three of four are eligible, half are final."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        key.cast("string").alias("article_id"), F.when(key % 4 == 0, "no").otherwise(" Yes").alias("eligible"), pick(key % 3, "Yes", "no", "unclear").alias("harms_status"),
        F.when(key % 2 == 0, "VOR").otherwise(selection.AIP).alias("publication_version"),
    )


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as reference events and as predictions of their customers. Two
    orders share no word; of an order found twice, the quotes are equal, or
    share one word of six, or none."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n, article = key % 10, F.col("o_custkey").cast("string").alias("article_id")
    gold = o.where(key % 3 != 0).select(
        F.concat(F.lit("G"), key).alias("event_id"), article, text("w", key, "x w", key, "y w", key, "z").alias("evidence_quote_raw"), text("term", key, "q").alias("event_term_raw"), F.lit("Late-Delivery").alias("category_canonical"),
        text(n).alias("numerator_value"), F.when(key % 4 == 1, " ").otherwise(text(n + 100, ".0")).alias("denominator_value"), F.when(key % 8 == 3, "").otherwise(text("Group ", n)).alias("arm_raw"), text(n).alias("arm_canonical"),
        text(n, " wks").alias("time_raw"), text(n, " weeks").alias("time_canonical"), F.lit("Transformable").alias("poolability"),
    )
    quote = pick(key % 7, text("v", key, "a v", key, "b"), *(F.when(key % 2 == 0, text("w", key, "z, w", key, "y w", key, "x")).otherwise(text("w", key, "x u", key, "a u", key, "b u", key, "c")),) * 6)
    predicted = o.where(key % 5 != 0).select(
        F.concat(F.lit("P"), key).alias("prediction_id"), article, quote.alias("evidence_quote"), text("Term", key, "q").alias("raw_event_term"), F.when(key % 9 == 0, "Loss").otherwise("late delivery").alias("predicted_category"),
        F.when(key % 4 == 0, n + 1).otherwise(n).cast("bigint").alias("numerator"), F.when(key % 4 == 2, F.lit(None)).otherwise(n + 100).cast("bigint").alias("denominator"), text("group ", n, " (n = 7)").alias("arm"),
        text(n, F.when(key % 2 == 0, " wks").otherwise(" days")).alias("time_window"), F.when(key % 6 == 1, "Not poolable").otherwise("Transformable").alias("poolability"),
    )
    return gold, predicted


EVENTS_SQL = """
WITH g AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 5 <> 0),
m AS (SELECT k, c, k % 10 AS n FROM g JOIN p USING (k, c) WHERE k % 7 <> 0 AND c % 4 <> 0),
positives AS (SELECT k, c FROM p WHERE c % 4 <> 0 AND k NOT IN (SELECT k FROM m)), negatives AS (SELECT k, c FROM g WHERE k NOT IN (SELECT k FROM m)),
z AS (SELECT 1.959963984540054::DOUBLE AS z)
"""


def _wilson_sql(a: str, n: str, name: str) -> str:
    p = f"(CAST({a} AS DOUBLE) / {n})"
    middle, half = f"({p} + z * z / (2 * CAST({n} AS DOUBLE)))", f"(z * sqrt(({p} * (1 - {p}) + z * z / (4 * CAST({n} AS DOUBLE))) / {n}))"
    return f"round(greatest(0.0::DOUBLE, ({middle} - {half}) / (1 + z * z / {n})), 10) AS {name}low, round(least(1.0::DOUBLE, ({middle} + {half}) / (1 + z * z / {n})), 10) AS {name}high"


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return E.outcomes(_articles(spark, sf_dir), *_events(spark, sf_dir))


@query(
    EVENTS_SQL
    + f""", c AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM positives) AS fp, (SELECT count(*) FROM negatives) AS fn)
SELECT tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 10) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 10) AS recall, round(2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn), 10) AS f1, {_wilson_sql("tp", "(tp + fp)", "precision_")}, {_wilson_sql("tp", "(tp + fn)", "recall_")} FROM c, z
"""
)
def event_scores(spark, sf_dir):
    """Matched, wrong and missed events, their rates and intervals."""
    e = E.event_metrics(*_outcomes(spark, sf_dir))
    bounds = [F.round(F.col(f"{m}_ci95")[b], 10).alias(f"{m}_{b}") for m in ("precision", "recall") for b in ("low", "high")]
    return e.select("tp", "fp", "fn", *(F.round(m, 10).alias(m) for m in ("precision", "recall", "f1")), *bounds)


@query(
    EVENTS_SQL
    + """
SELECT 'G' || k AS event_id, 'P' || k AS prediction_id, CAST(c AS VARCHAR) AS article_id, CASE WHEN k % 2 = 0 THEN 'route_1' ELSE 'route_2' END AS route, CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 1::DOUBLE / 6 END AS quote_jaccard, 1.0::DOUBLE AS term_similarity, k % 9 <> 0 AS category_exact,
  round(0.6::DOUBLE * CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 1::DOUBLE / 6 END + 0.3::DOUBLE + CASE WHEN k % 9 <> 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 10) AS rank_score, 'term' || k || 'q' AS gold_event_term, 'Term' || k || 'q' AS predicted_event_term FROM m
"""
)
def matched_events(spark, sf_dir):
    """One-to-one matches with both sides' columns."""
    matches, *_ = _outcomes(spark, sf_dir)
    flat = E.flat_matches(matches, *_events(spark, sf_dir))
    return flat.select("event_id", "prediction_id", "article_id", "route", "quote_jaccard", "term_similarity", "category_exact", F.round("rank_score", 10).alias("rank_score"), "gold_event_term", "predicted_event_term")


@query(EVENTS_SQL + "SELECT 'FP' AS kind, 'P' || k AS id, CAST(c AS VARCHAR) AS article_id FROM positives UNION ALL SELECT 'FN', 'G' || k, CAST(c AS VARCHAR) FROM negatives")
def event_errors(spark, sf_dir):
    """Predictions without an event, events without a prediction."""
    _, positives, negatives = _outcomes(spark, sf_dir)
    return positives.select(F.lit("FP").alias("kind"), F.col("prediction_id").alias("id"), "article_id").unionByName(negatives.select(F.lit("FN").alias("kind"), F.col("event_id").alias("id"), "article_id"))


ARTICLE_COUNTS_SQL = (
    EVENTS_SQL
    + """
SELECT CAST(c_custkey AS VARCHAR) AS article_id, (SELECT count(*) FROM m WHERE c = c_custkey) AS tp, (SELECT count(*) FROM positives WHERE c = c_custkey) AS fp, (SELECT count(*) FROM negatives WHERE c = c_custkey) AS fn FROM customer WHERE c_custkey % 4 <> 0
"""
)


@query(ARTICLE_COUNTS_SQL)
def article_scores(spark, sf_dir):
    """The same counts of each eligible article."""
    return E.article_counts(_articles(spark, sf_dir), *_outcomes(spark, sf_dir))


@query(
    EVENTS_SQL
    + f""", f AS (SELECT 'category_canonical_exact' AS metric, count(*) FILTER (k % 9 <> 0) AS correct, count(*) AS eligible FROM m
UNION ALL SELECT 'numerator_value_exact', count(*) FILTER (k % 4 <> 0), count(*) FROM m
UNION ALL SELECT 'denominator_value_exact', count(*) FILTER (k % 4 IN (0, 3)), count(*) FILTER (k % 4 <> 1) FROM m
UNION ALL SELECT 'arm_raw_exact', 0, count(*) FILTER (k % 8 <> 3) FROM m UNION ALL SELECT 'arm_canonical_exact', count(*), count(*) FROM m
UNION ALL SELECT 'time_raw_exact', count(*) FILTER (k % 2 = 0), count(*) FROM m UNION ALL SELECT 'time_canonical_exact', count(*) FILTER (k % 2 = 0), count(*) FROM m
UNION ALL SELECT 'poolability_exact', count(*) FILTER (k % 6 <> 1), count(*) FROM m)
SELECT metric, correct, eligible, round(CAST(correct AS DOUBLE) / eligible, 10) AS accuracy, {_wilson_sql("correct", "eligible", "")} FROM f, z
"""
)
def field_scores(spark, sf_dir):
    """Of matched events, the fields that agree: by text, number, arm, time."""
    matches, *_ = _outcomes(spark, sf_dir)
    f = E.field_metrics(matches, *_events(spark, sf_dir))
    rows = f.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("a")) for n in E.FIELDS))).alias("m"))
    return rows.select("m.metric", "m.a.correct", "m.a.eligible", *(F.round(F.col("m.a")[x], 10).alias(x) for x in ("accuracy",)), *(F.round(F.col("m.a.ci95")[b], 10).alias(b) for b in ("low", "high")))


@query(bootstrap_sql(ARTICLE_COUNTS_SQL, "orders"))
def bootstrap_articles(spark, sf_dir):
    """Intervals of the event scores when articles are drawn anew, 10,000
    times, by a seeded sequence."""
    b = E.bootstrap(E.article_counts(_articles(spark, sf_dir), *_outcomes(spark, sf_dir)), "orders")
    return b.select(*(F.round(F.col(m)[i], 12).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for i, n in enumerate(("low", "high"))))


@query(
    """
SELECT 'article' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'event', 'G' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 AND c_custkey % 2 = 0
UNION ALL SELECT 'prediction', 'P' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0 AND c_custkey % 2 = 0
"""
)
def version_subset(spark, sf_dir):
    """Articles of one publication version, their events and predictions."""
    a, g, p = E.subset(_articles(spark, sf_dir), *_events(spark, sf_dir), "VOR")
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return named(a, "article", "article_id").unionByName(named(g, "event", "event_id")).unionByName(named(p, "prediction", "prediction_id"))


@query("""
WITH s AS (SELECT DISTINCT printf('AH-S2C-%03d_doi_%d', o_custkey % 1000, o_custkey) AS sealed_article_id, printf('AH-S2C-%03d', o_custkey % 1000) AS normalized_article_id FROM orders)
SELECT *, normalized_article_id IN (SELECT printf('AH-S2C-%03d', c_custkey % 1000) FROM customer WHERE c_custkey % 3 = 0) AS in_main FROM s
""")
def id_crosswalk(spark, sf_dir):
    """Long article ids to short ones, and whether those are known."""
    short = lambda key: F.format_string("AH-S2C-%03d", F.col(key) % 1000)
    predicted = table(spark, sf_dir, "orders").select(F.concat(short("o_custkey"), F.lit("_doi_"), F.col("o_custkey").cast("string")).alias("article_id"))
    return E.crosswalk(predicted, table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(short("c_custkey").alias("article_id")))


@query("""
WITH p AS (SELECT o_orderkey, printf('AH-S2C-%03d', o_custkey % 1000) AS article_id FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT DISTINCT printf('AH-S2C-%03d', c_custkey % 1000) AS article_id FROM customer WHERE c_custkey % 3 = 0)
SELECT 'kept' AS kind, article_id, count(*) AS n FROM p WHERE article_id IN (FROM a) GROUP BY ALL UNION ALL SELECT 'without', article_id, 1 FROM a WHERE article_id NOT IN (SELECT article_id FROM p)
""")
def normalised_ids(spark, sf_dir):
    """Predictions under short ids, and articles that have none."""
    short = lambda key: F.format_string("AH-S2C-%03d", F.col(key) % 1000)
    predicted = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.concat(short("o_custkey"), F.lit("_x")).alias("article_id"))
    kept, without = E.normalised(predicted, table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(short("c_custkey").alias("article_id")).distinct())
    return kept.groupBy(F.lit("kept").alias("kind"), "article_id").agg(F.count(F.lit(1)).alias("n")).unionByName(without.select(F.lit("without").alias("kind"), "article_id", F.lit(1).cast("long").alias("n")))


PARTS_SQL = """
WITH n AS (SELECT count(*) AS n FROM supplier), a AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 'vor' ELSE 'aip' END AS v FROM supplier),
g AS (SELECT p_partkey AS k, p_partkey % n AS s FROM part, n WHERE p_partkey % 3 <> 0), p AS (SELECT p_partkey AS k, p_partkey % n AS s FROM part, n WHERE p_partkey % 5 <> 0),
m AS (SELECT k, s FROM g JOIN p USING (k, s) WHERE s % 4 <> 3), e AS (SELECT 'tp' AS kind, s FROM m UNION ALL SELECT 'fp', s FROM p WHERE s % 4 <> 3 AND k NOT IN (SELECT k FROM m) UNION ALL SELECT 'fn', s FROM g WHERE k NOT IN (SELECT k FROM m)),
t AS (SELECT v AS part, kind FROM e JOIN a USING (s) UNION ALL SELECT 'main', kind FROM e)
"""


@query(
    PARTS_SQL
    + """
SELECT part, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'tp') AS match_rows, count(*) FILTER (kind = 'fp') AS positive_rows, count(*) FILTER (kind = 'fn') AS negative_rows, TRUE AS hash_holds FROM t GROUP BY part
"""
)
def scoring_files(spark, sf_dir):
    """A whole scoring run over parts of suppliers, its files read back."""
    n, key = table(spark, sf_dir, "supplier").count(), F.col("p_partkey")
    short = lambda k: F.format_string("AH-S2C-%03d", k)
    s = table(spark, sf_dir, "supplier")
    articles = s.select(short(F.col("s_suppkey")).alias("article_id"), F.when(F.col("s_suppkey") % 4 == 3, "no").otherwise("yes").alias("eligible"), F.lit("yes").alias("harms_status"), F.when(F.col("s_suppkey") % 2 == 0, "VOR").otherwise(selection.AIP).alias("publication_version"))
    p = table(spark, sf_dir, "part").withColumn("article_id", short(key % n))
    said = text("a", key, "x a", key, "y")
    blank = lambda *names: [F.lit("").alias(x) for x in names]
    gold = p.where(key % 3 != 0).select(text("G", key).alias("event_id"), "article_id", said.alias("evidence_quote_raw"), text("t", key, "q").alias("event_term_raw"), F.lit("C").alias("category_canonical"), *blank("numerator_value", "denominator_value", "arm_raw", "arm_canonical", "time_raw", "time_canonical", "poolability"))
    predicted = p.where(key % 5 != 0).select(text("P", key).alias("prediction_id"), F.concat("article_id", F.lit("_doi")).alias("article_id"), said.alias("evidence_quote"), text("t", key, "q").alias("raw_event_term"), F.lit("C").alias("predicted_category"), *blank("arm", "time_window", "poolability"), *(F.lit(1).cast("bigint").alias(x) for x in ("numerator", "denominator")))
    out = Place(folder(spark, "scoring"))
    score(articles, gold, predicted, out, "parts")
    lock, rows = read_json(out / "scoring_lock.json"), []
    for part in ("main", "vor", "aip"):
        level = read_json(out / f"{part}_metrics.json")["event_level"]
        counts = [tabular.read_csv(spark, f"{out}/{part}_{kind}.csv").count() for kind in ("matches", "false_positives", "false_negatives")]
        rows.append((part, level["TP"], level["FP"], level["FN"], *counts, sha256(out / f"{part}_metrics.json") == lock[f"{part}_metrics.json_sha256"]))
    return spark.createDataFrame(rows, "part string, tp long, fp long, fn long, match_rows long, positive_rows long, negative_rows long, hash_holds boolean")


# ---- work queues ----


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as candidates, by page or by PDF; audits of the PDFs, and hosts,
    some of them given twice, of which the last holds."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    doi, row = lambda prefix: text(prefix, key), key.cast("long").alias("row_no")
    pool = p.select(
        text("C", key).alias("source_candidate_id"), doi("10.1/A").alias("doi"), F.col("p_name").alias("title"), F.concat("p_brand", F.lit("-"), "p_size").alias("journal"), F.when(key % 2 == 0, "AUTOMATED_PUBLISHER_HTML").otherwise("MANUAL_PUBLISHER_PDF").alias("source_route"),
        text(key, ".nxml").alias("normalized_file"), F.sha2(text("own", key), 256).alias("normalized_sha256"), F.when(key % 10 == 3, "FAIL").otherwise("PASS").alias("document_gate"),
        F.when(key % 20 == 6, "OVERLAP").otherwise("NO_EXACT_DOI_TITLE_OR_REGISTRY_OVERLAP").alias("old_20_plus_60_overlap_status"), F.lit("PASS_ONE").alias("trial_family_status"),
        pick(key % 8, selection.AIP, "VOR", "VOR", "VOR", "VOR", "VOR", "PREPRINT", "VOR").alias("publication_version"), F.sha2(text("source", key), 256).alias("source_sha256"), row,
    )
    odd = p.where(key % 2 == 1)
    audit = lambda rows, status, shift: rows.select(doi("10.1/a").alias("doi"), F.lit(status).alias("table_format_status"), text("pdf", key, ".nxml").alias("normalized_file"), F.sha2(text("pdf", key), 256).alias("normalized_sha256"), (key + shift).cast("long").alias("row_no"))
    pdf = audit(odd.where(key % 3 != 0), "PASS_COORDINATE_TABLES", 0).unionByName(audit(odd.where(key % 5 == 0), "REVIEW_NO_RELIABLE_TABLE", 10_000_000))
    hosts = p.where(key % 4 != 1).select(doi("10.1/a").alias("doi"), pick(key % 6, "Wiley", "Elsevier BV", "BioMed Central", "Nature Portfolio", "SAGE Publishing", "Some press").alias("oa_host"), row)
    return pool, pdf, hosts.unionByName(p.where(key % 12 == 2).select(doi("10.1/A").alias("doi"), F.lit("Wolters Kluwer").alias("oa_host"), (key + 10_000_000).cast("long").alias("row_no")))


POOL_SQL = """
WITH RECURSIVE h AS (SELECT p_partkey AS k, p_brand || '-' || p_size AS journal, CASE WHEN p_partkey % 12 = 2 THEN 'Wolters Kluwer' WHEN p_partkey % 4 = 1 THEN '' ELSE ['Wiley', 'Elsevier BV', 'BioMed Central', 'Nature Portfolio', 'SAGE Publishing', 'Some press'][1 + p_partkey % 6] END AS oa_host,
  CASE WHEN p_partkey % 2 = 0 THEN 'PASS_PUBLISHER_HTML_STRUCTURAL_GATE' WHEN p_partkey % 5 = 0 THEN 'REVIEW_NO_RELIABLE_TABLE' WHEN p_partkey % 3 <> 0 THEN 'PASS_COORDINATE_TABLES' ELSE 'MISSING_PDF_AUDIT' END AS format_gate_final,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.nxml' WHEN p_partkey % 3 <> 0 OR p_partkey % 5 = 0 THEN 'pdf' || p_partkey || '.nxml' ELSE '' END AS final_normalized_file,
  CASE WHEN p_partkey % 8 = 0 THEN 'PUBLISHER_AIP_COMPLETE' WHEN p_partkey % 8 = 6 THEN 'PREPRINT' ELSE 'VOR' END AS publication_version FROM part),
a AS MATERIALIZED (SELECT *, CASE oa_host WHEN 'Elsevier BV' THEN 'Elsevier' WHEN 'BioMed Central' THEN 'Springer Nature' WHEN 'Nature Portfolio' THEN 'Springer Nature' WHEN 'SAGE Publishing' THEN 'SAGE' WHEN '' THEN 'Independent/Unresolved' ELSE oa_host END AS publisher_family, 'C' || k AS source_candidate_id,
  k % 10 <> 3 AND k % 20 <> 6 AND publication_version <> 'PREPRINT' AND format_gate_final LIKE 'PASS%' AS good, sha256('factloom-queue|C' || k || '|' || sha256('source' || k)) AS selection_key FROM h)
"""


@query(
    POOL_SQL
    + """
SELECT source_candidate_id, oa_host, publisher_family, final_normalized_file, CASE WHEN final_normalized_file = '' THEN '' WHEN k % 2 = 0 THEN sha256('own' || k) ELSE sha256('pdf' || k) END AS final_normalized_sha256, format_gate_final,
  CASE WHEN good THEN 'ELIGIBLE_ALL_PREFREEZE_GATES' ELSE 'EXCLUDE_FORMAT_OR_SOURCE_GATE:' || format_gate_final END AS final_eligibility, selection_key FROM a
"""
)
def audited_pool(spark, sf_dir):
    """Candidates with host, family, file and gates from their audits."""
    return selection.audited(*_pool(spark, sf_dir), SEED).select("source_candidate_id", "oa_host", "publisher_family", "final_normalized_file", "final_normalized_sha256", "format_gate_final", "final_eligibility", "selection_key")


QUEUE_SQL = queue_sql(POOL_SQL, 50)


@query(
    QUEUE_SQL
    + """
SELECT queue_role, role_order, source_candidate_id, publisher_family, journal FROM queued
"""
)
def work_queue(spark, sf_dir):
    """Calibration, main set of 50 under all caps, reserves."""
    audit = selection.audited(*_pool(spark, sf_dir), SEED)
    return selection.queue(audit.where(F.col("final_eligibility") == selection.ELIGIBLE), SEED).select("queue_role", "role_order", "source_candidate_id", "publisher_family", "journal")


@query(
    POOL_SQL
    + """
SELECT 'audit' AS file, '' AS role, count(*) AS n, TRUE AS hash_holds FROM a UNION ALL SELECT 'excluded', '', count(*) FILTER (NOT good), TRUE FROM a
UNION ALL SELECT 'queue', role, CASE role WHEN 'CALIBRATION' THEN 5 WHEN 'MAIN_EXTERNAL' THEN 50 ELSE (SELECT count(*) FILTER (good) - 55 FROM a) END, TRUE FROM (VALUES ('CALIBRATION'), ('MAIN_EXTERNAL'), ('RESERVE')) v(role)
"""
)
def queue_files(spark, sf_dir):
    """The files of a queue, read back."""
    out = Place(folder(spark, "queue-files"))
    summary = queueing.write_queue(*_pool(spark, sf_dir), out, SEED)
    parts = []
    for name, file in (("audit", "eligibility_audit"), ("excluded", "excluded"), ("queue", "queue")):
        rows = tabular.read_csv(spark, f"{out}/{file}.csv", ["source_candidate_id", "selection_key"])
        holds = sha256(out / f"{file}.csv") == summary[f"{file}_sha256"]
        if name == "queue":
            counted = selection.role_counts(rows).select(F.lit(name).alias("file"), F.col("queue_role").alias("role"), F.col("count").alias("n"))
        else:
            counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("file"), F.lit("").alias("role"), "n")
        parts.append(counted.withColumn("hash_holds", F.lit(holds)))
    return sinks.union_rows(*parts)


# ---- hashes ----


@query("""
SELECT 'f' || o_orderkey AS name, CASE WHEN o_orderkey % 5 <> 0 THEN sha256(o_orderkey || o_orderstatus) END AS expected, CASE WHEN o_orderkey % 7 <> 0 THEN sha256(o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE o_orderstatus END) END AS found FROM orders
WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
""")
def hash_mismatches(spark, sf_dir):
    """Names whose hashes differ, or stand on one side only."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sides = lambda skip, status: o.where(key % skip != 0).select(text("f", key).alias("name"), F.sha2(text(key, status), 256).alias("sha256"))
    return G.mismatches(sides(5, F.col("o_orderstatus")), sides(7, F.when(key % 9 == 0, "x").otherwise(F.col("o_orderstatus"))))


@query("SELECT printf('S%06d.txt', s_suppkey) AS name, sha256(s_name) AS sha256, octet_length(encode(s_name)) AS n_bytes FROM supplier")
def written_files(spark, sf_dir):
    """A file per supplier, written by the tasks and hashed from the folder."""
    path = folder(spark, "files")
    made = sinks.write_files(table(spark, sf_dir, "supplier").select(F.format_string("S%06d.txt", "s_suppkey").alias("name"), F.encode("s_name", "UTF-8").alias("content")), path)
    return made.join(G.file_hashes(spark, path, "*.txt"), ["name", "sha256"])


@query("""
SELECT 'inputs/' || n_nationkey || '.txt' AS item, sha256(n_name) AS said FROM nation UNION ALL SELECT 'code/rules.json', sha256('[1, 2]') UNION ALL SELECT 'seal', 'SEALED_BEFORE_STAGEII_CLINICIAN_ANNOTATION_AND_SCORING 2'
UNION ALL SELECT 'guarded', 'a path resembles reference or adjudication material' UNION ALL SELECT 'kept', 'refused' UNION ALL SELECT 'verified', 'PASS' UNION ALL SELECT 'changed', 'FAIL' UNION ALL SELECT 'unsealed', 'the predictions are not those that were sealed'
""")
def capsule_checks(spark, sf_dir):
    """A capsule of files by nation: frozen, sealed, verified, tampered with."""
    root = Place(folder(spark, "capsule"))
    made = sinks.write_files(table(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content")), f"{root}/sources")
    inputs = {r.name: root / "sources" / r.name for r in made.select("name").collect()}
    (root / "rules.json").write_text("[1, 2]")
    manifest = G.freeze(root / "frozen", inputs, {"rules.json": root / "rules.json"})
    said = list(manifest["files"].items())
    G.seal(root / "rules.json", [root / "frozen" / "MANIFEST.json"], root / "seal.json")
    try:
        sinks.guard_paths(root / "Reference_Standard")
    except PermissionError as refused:
        said.append(("guarded", str(refused)))
    try:
        G.freeze(root / "frozen", {}, {})
    except FileExistsError:
        said.append(("kept", "refused"))
    seal = G.check_seal(root / "seal.json", root / "rules.json", root / "frozen" / "MANIFEST.json")
    said.append(("seal", f"{seal['status']} {seal['prediction_count']}"))
    rerun = lambda capsule, out: (out / "0.txt").write((capsule / "inputs/0.txt").chunks())
    expected = {"0.txt": manifest["files"]["inputs/0.txt"]}
    said.append(("verified", G.verify(root / "frozen", rerun, expected, root / "first")["status"]))
    (root / "frozen/inputs/0.txt").write_text("other")
    said.append(("changed", G.verify(root / "frozen", rerun, expected, root / "second")["status"]))
    (root / "rules.json").write_text(json.dumps([1]))
    try:
        G.check_seal(root / "seal.json", root / "rules.json")
    except ValueError as refused:
        said.append(("unsealed", str(refused)))
    return spark.createDataFrame(said, "item string, said string")
